"""Chat formatting of typed content parts.

A message's content is a list of parts: text, image, audio, document. A visitor walks them in order and flattens them
into one string: texts escaped, attachments as ordered placeholders, each recorded as a reference with the tokens that
it will take when it is expanded. The template marks a turn as `### Role: ` ... ` </turn>` and a line feed; inside texts
and roles every backslash, `#` and `<`, in roles `:` too, gets a backslash before it, so no text can look like a mark and unescaping gives the text back.
Text parts of assistant turns carry the loss mask, as spans of the formatted segment.

Rows are formatted where they lie; one exchange then brings each conversation's turns together in order, and digests are
made as they stream by, so a conversation of any length takes bounded memory.

Cases: a null text is empty; a null role is the empty role; turns that tie are ordered by role, then text; repeated rows
are turns of their own; null conversation ids are one conversation; an empty table gives none; other columns are not kept.
Of typed contents: what is no JSON list of parts is one text part, whole; an element that is no object is its text; a part of
an unknown kind is an attachment of that kind, without tokens, whose reference is the part as JSON; figures that are no
numbers count as absent.
"""

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

ship(__name__)
_ESCAPE, _ESCAPE_ROLE, _UNESCAPE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
OPEN, CLOSE = "### {}: ", " </turn>\n"
#: Tokens that a part of a kind stands for: of an image by tiles of 512 x 512, of audio by seconds, of a document by pages.
PER_TILE, PER_SECOND, PER_PAGE = 170, 25, 500


def escape(text: str, marks: re.Pattern = _ESCAPE) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def _number(part: dict, name: str, absent: float) -> float:
    """A figure of a part, not negative; else what stands for an absent one."""
    try:
        x = float(part.get(name) or absent)
    except (TypeError, ValueError):
        return absent
    return x if 0 <= x < 1e15 else absent


def parts_of(content: str) -> list[dict]:
    """The parts that a typed content lists."""
    try:
        found = json.loads(content or "[]")
    except ValueError:
        found = None
    if not isinstance(found, list):
        return [{"type": "text", "text": content}]
    return [x if isinstance(x, dict) else {"type": "text", "text": x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)} for x in found]


class Flatten:
    """Visits parts in order; `out` is the flattened text, `spans` its text parts, `attached` the references."""

    def __init__(self) -> None:
        self.out, self.size, self.spans, self.attached = [], 0, [], []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, part: dict) -> None:
        text = escape(str(part.get("text") or ""))
        if text:
            self.spans.append((self.size, self.size + len(text)))
            self._put(text)

    def _attach(self, part: dict, tokens: int) -> None:
        k = len(self.attached)
        self._put(f"<{escape(str(part['type']), _ESCAPE_ROLE)}:{k}>")
        self.attached.append({"kind": str(part["type"]), "order": k, "ref": str(part.get("ref") or ""), "tokens": tokens})

    def visit_other(self, part: dict) -> None:
        self._attach({"type": part["type"], "ref": json.dumps(part, ensure_ascii=False, sort_keys=True)}, 0)

    def visit_image(self, part: dict) -> None:
        wide, high = (max(1, int(-(-_number(part, x, 1) // 512))) for x in ("width", "height"))
        self._attach(part, PER_TILE * wide * high)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, int(-(-PER_SECOND * _number(part, "seconds", 0) // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, PER_PAGE * int(_number(part, "pages", 1)))


def format_turn(role: str, parts: list[dict]) -> dict:
    """The segment, the loss spans in it (of assistant turns), its attachments and their tokens."""
    walk = Flatten()
    for part in parts:
        walk.visit(part)
    head = OPEN.format(escape(role, _ESCAPE_ROLE))
    spans = [(a + len(head), b + len(head)) for a, b in walk.spans] if role == "assistant" else []
    return {"segment": head + "".join(walk.out) + CLOSE, "loss": spans, "attached": walk.attached, "expanded_tokens": sum(x["tokens"] for x in walk.attached)}


_FORM = "struct<segment:string,loss:array<struct<a:int,b:int>>,attached:array<struct<kind:string,order:int,ref:string,tokens:long>>,expanded_tokens:long>"


def format_turns(turns: DataFrame, content: str = "text", typed: bool = False) -> DataFrame:
    """turns and `form`: segment, loss, attached, expanded_tokens. typed: content is a JSON list of parts, else plain text."""

    @F.pandas_udf(_FORM)
    def of(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for role, x in zip(roles, contents):
            x = x if isinstance(x, str) else ""
            made = format_turn(role if isinstance(role, str) else "", parts_of(x) if typed else [{"type": "text", "text": x}])
            rows.append((made["segment"], [{"a": a, "b": b} for a, b in made["loss"]], made["attached"], made["expanded_tokens"]))
        return pd.DataFrame(rows, columns=["segment", "loss", "attached", "expanded_tokens"])

    return turns.withColumn("form", of("role", content))


_TURN = re.compile(r"### ((?:\\.|[^\\#<:])*): (.*) </turn>\n", re.S)


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted segment without attachments."""
    found = _TURN.fullmatch(segment)
    return unescape(found[1]), unescape(found[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the segments and masks alone, in the order of turns."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, got = object(), None

        def row() -> tuple:
            return (None if at == "" else int(at), got[0], got[1].hexdigest(), got[2], got[3].hexdigest(), got[4])

        for batch in batches:
            done = []
            for conv, segment, loss in zip(batch["conv_id"], batch["segment"], batch["loss"]):
                conv = "" if conv is None or conv != conv else conv
                if conv != at:
                    if got:
                        done.append(row())
                    at, got = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(segment)
                got[0] += 1
                got[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    part = unescape(segment[span["a"] : span["b"]])
                    got[2] += len(part)
                    got[3].update(part.encode())
                got[4] += len(segment)
            yield _frame(done)
        if got:
            yield _frame([row()])

    dealt = formatted.select("conv_id", "turn", "role", "form.segment", "form.loss").repartition("conv_id")
    # ties go by role, then by text as it was before it was escaped
    said = F.regexp_replace(F.expr(f"left(segment, length(segment) - {len(CLOSE)})"), r"(?s)\\(.)", "$1")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), said)
    return dealt.select("conv_id", "segment", "loss").mapInPandas(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")
    ).select("conv_id", "x.turn", "x.role", F.lit(said).alias("text"))
    return digests(format_turns(turns.unionByName(probe)))


_SQL_TEXT = "coalesce(text, '')"
_SQL_ESCAPED = r"length(regexp_replace({}, '([\\#<{}])', '\\\1', 'g'))"
OP9_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, {_SQL_TEXT} as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       sum({len(OPEN.format(""))} + {len(CLOSE)} + {_SQL_ESCAPED.format("role", ":")} + {_SQL_ESCAPED.format("text", "")})::bigint as formatted_chars
from c group by conv_id
"""
