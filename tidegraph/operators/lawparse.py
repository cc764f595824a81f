"""Structured extraction: law articles by pattern, news cases from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import in_order

CASE_SCHEMA = (
    "struct<cases:array<struct<name:string,summary:string,date:string,location:string,charges:array<string>,"
    "substances:array<struct<name:string,amount:string>>,people:array<struct<name:string,aliases:array<string>,role:string,charge:string,sentence:string>>>>>"
)
PROMPT_CHARS = 12_000


def parse_articles(docs: DataFrame) -> DataFrame:
    """docs (id, content, metadata): (id, law, title, doc_id, crime, clauses), clauses nested as in the text."""
    meta = lambda k: F.element_at("metadata", k)
    head = F.locate(". ", meta("title"))
    title = F.when(head > 0, F.substring(meta("title"), head + 2, F.length(meta("title")))).otherwise(meta("title"))
    out = docs.select(meta("article").alias("article"), F.coalesce(meta("law"), F.lit("")).alias("law"), title.alias("title"), F.col("id").alias("doc_id"), X.segment_clauses(X.drop_footnotes("content")).alias("parts"))
    clause = lambda c: F.struct(
        F.concat("article", F.lit(" khoản "), F.regexp_extract(c, r"(?U)\A(\d+)\.", 1)).alias("id"), X.clause_number(c).alias("number"), X.penalty(c).alias("penalty"),
        c.alias("text"), X.find_terms(c).alias("substances"),
    )
    crime = F.when(F.startswith("title", F.lit(X.CRIME_TITLE)), X.normalize_name("title"))
    return out.select(F.col("article").alias("id"), "law", "title", "doc_id", crime.alias("crime"), F.transform("parts", clause).alias("clauses"))


def parse_cases(raw: DataFrame, answer: str = "answer") -> DataFrame:
    """raw and `cases`: what the model's JSON names; broken JSON or anything but an object gives none."""
    parsed = F.from_json("_text", CASE_SCHEMA, {"mode": "PERMISSIVE"})
    is_object = F.rlike("_text", F.lit(r"(?s)\A\s*\{"))
    empty = F.from_json(F.lit('{"cases": []}'), CASE_SCHEMA)["cases"]
    # a column of its own, for it is asked for twice
    return raw.withColumn("_text", X.strip_fences(answer)).withColumn("cases", F.coalesce(F.when(is_object, parsed["cases"]), empty)).drop("_text")


# The wording of the prompt. Names in braces are slots.
NEWS_PROMPT = """Bạn trích xuất knowledge graph từ một bài báo tiếng Việt về ma túy.
Chỉ dùng thông tin có trong bài. Trả về JSON đúng dạng:
{"cases": [{
  "name": "tên ngắn của vụ việc, ví dụ: Vụ mua bán 36kg ma túy tại TP.HCM",
  "summary": "1-2 câu tóm tắt",
  "date": "ngày xảy ra/xét xử nếu có, dạng YYYY-MM-DD hoặc chuỗi rỗng",
  "location": "tỉnh/thành phố, chuỗi rỗng nếu không rõ",
  "charges": ["tội danh, BẮT BUỘC chọn đúng nguyên văn từ DANH SÁCH TỘI DANH"],
  "substances": [{"name": "tên chất, dùng tên chuẩn trong DANH SÁCH CHẤT nếu khớp", "amount": "khối lượng nếu có"}],
  "people": [{"name": "họ tên", "aliases": ["biệt danh"], "role": "bị cáo|bị can|nghi phạm|người liên quan|cán bộ",
               "charge": "tội danh của người này (từ DANH SÁCH TỘI DANH) hoặc chuỗi rỗng",
               "sentence": "mức án nếu có, ví dụ: tử hình, 8 năm tù"}]
}]}
Bài không nói về vụ việc cụ thể (tuyên truyền, hội nghị...) thì trả về {"cases": []}.

DANH SÁCH TỘI DANH: {crimes}
DANH SÁCH CHẤT: {substances}

Tiêu đề: {title}
Nội dung:
{content}"""


def known_crimes(articles: DataFrame) -> DataFrame:
    """(name, ord): the crimes that articles define, each once, numbered from 1 in their order."""
    return in_order(articles.filter("crime is not null and crime != ''").select(F.col("crime").alias("name")).distinct(), "name", "ord")


def news_prompt(docs: DataFrame, crimes: DataFrame) -> DataFrame:
    """docs (id, content, metadata) and `prompt` for a model that returns cases as JSON. crimes: (name, ord), a short list in every prompt."""
    listed = crimes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "; ").alias("_crimes"))  # one row
    prompt = X.fill(
        NEWS_PROMPT, crimes=F.col("_crimes"), substances=F.lit(", ".join(X.SUBSTANCES)),
        title=F.coalesce(F.element_at("metadata", "title"), F.lit("")), content=F.substring("content", 1, PROMPT_CHARS),
    )
    return docs.crossJoin(F.broadcast(listed)).withColumn("prompt", prompt).drop("_crimes")
