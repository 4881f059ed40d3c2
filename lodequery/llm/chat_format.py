"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, which a deterministic parser reads back::

    conversation = { turn }
    turn         = "### " role ": " body "\\n</turn>\\n"
    role         = "User" | "Assistant" | "System" | "=" other role, URL-encoded

Every turn ends at the first ``\\n</turn>\\n``; no other line may look like a
turn's first line. A backslash before ``\\``, ``#`` or ``<`` stands for that
character alone. Each turn is first rendered as it is and parsed again; where the
recovered turn is not identical to its source, its control strings are escaped,
and where that is not enough, every backslash, ``#`` and ``<``.

Null texts and roles are empty; a null conversation id is a conversation of its
own; rows with equal turn numbers (nulls last) are ordered by role and text, so
repeated rows stay and give equal results; very long texts are formatted whole;
an empty table gives an empty result; other columns are left out. A conversation
is one formatted string, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

# The grammar's strings.
END = "\n</turn>\n"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
LOSS_ROLE = "assistant"

_HEAD = r"(?s)\A### (User|Assistant|System|=[^:\n]*+): (.*)\z"
_STRAY_HEAD = r"(?m)^### "


def _unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([\\#<])", "$1")


def _escaped_all(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\#<])", r"\\$1")


def _escaped_marks(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?m)^###", r"\\###"), "</turn>", r"\\</turn>")


def _role_mark(role: Column) -> Column:
    known = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in ROLES.items()])
    other = F.concat(F.lit("="), F.url_encode(role))
    return F.coalesce(known, other)


def _role_of(mark: Column) -> Column:
    known = F.coalesce(*[F.when(mark == v, F.lit(k)) for k, v in ROLES.items()])
    other = F.url_decode(F.substring(mark, 2, 1 << 30))
    return F.coalesce(known, other)


def render(role: Column, body: Column) -> Column:
    """One turn of the grammar; the body is already escaped."""
    return F.concat(F.lit("### "), _role_mark(role), F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of structs of role and text.

    A piece that is not a turn, or has a stray first line inside, becomes a null struct.
    """
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.when(
            p.rlike(_HEAD) & ~F.regexp_extract(p, _HEAD, 2).rlike(_STRAY_HEAD),
            F.struct(_role_of(F.regexp_extract(p, _HEAD, 1)).alias("role"), _unescaped(F.regexp_extract(p, _HEAD, 2)).alias("text")),
        ),
    )
    return F.when(F.element_at(pieces, -1) == "", turns)


def render_until_identical(role: Column, text: Column) -> Column:
    """The turn with the least escaping that its own parse gives back unchanged."""
    want = F.array(F.struct(role.alias("role"), text.alias("text")))
    tries = [render(role, e) for e in (text, _escaped_marks(text), _escaped_all(text))]
    out = tries[-1]
    for t in reversed(tries[:-1]):
        out = F.when(parse(t).eqNullSafe(want), t).otherwise(out)
    return out


def chat_format(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id, formatted, turns, loss_spans, round_trip``.

    ``turns`` is read back from ``formatted``; ``loss_spans`` has the places (start and end, in
    characters of ``formatted``) of the bodies under the loss mask; ``round_trip`` says whether the
    turns read back are those of the source.
    """
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    conflict = F.col("text").rlike(r"[\\#<]") | ~F.col("role").isin(*ROLES)
    rendered = F.when(conflict, render_until_identical(F.col("role"), F.col("text"))).otherwise(render(F.col("role"), F.col("text")))
    rows = rows.withColumn("rendered", rendered).withColumn("last", F.col("turn").isNull())
    order = W.partitionBy("conv_id").orderBy("last", "turn", "role", "text")
    rows = rows.withColumn("end", F.sum(F.length("rendered")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    head = F.length(F.concat(F.lit("### "), _role_mark(F.col("role")), F.lit(": ")))
    span = F.struct((F.col("end") - F.length("rendered") + head).cast("long").alias("start"), (F.col("end") - len(END)).cast("long").alias("end"))
    rows = rows.withColumn("loss", F.when(F.col("role") == LOSS_ROLE, span))
    item = F.struct("end", "role", "text", "rendered", "loss")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    grouped = grouped.withColumn("formatted", F.array_join(F.col("items.rendered"), ""))
    grouped = grouped.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.filter(F.col("items.loss"), lambda x: x.isNotNull())
    return grouped.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), F.col("turns").eqNullSafe(source).alias("round_trip"))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The text of each span of a formatted string, without its escapes.

    Spans are places of code points; in four bytes each, a span is cut out without counting from the start.
    """

    def cut(points: Column) -> Column:
        place = lambda x: 4 * x.cast("int")
        return F.transform(
            spans, lambda s: _unescaped(F.decode(F.substring(points, place(s["start"]) + 1, place(s["end"] - s["start"])), "UTF-32"))
        )

    return F.get(F.transform(F.array(F.encode(formatted, "UTF-32")), cut), F.lit(0))


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of the turns that were read back and of the formatted text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return formatted.withColumn("_loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(chat_format(rows.unionByName(extra)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (
  SELECT *, CASE
      WHEN NOT regexp_matches(text, '\\[\\#<]') AND NOT contains(text || chr(10) || '</turn>' || chr(10) || '.', chr(10) || '</turn>' || chr(10) || '</turn>' || chr(10))
        AND NOT contains(text, chr(10) || '</turn>' || chr(10)) AND NOT regexp_matches(text, '(^|\n)### ') THEN 0
      WHEN NOT regexp_matches(text, '\\[\\#<]') THEN length(regexp_extract_all(text, '(^|\n)###')) + length(regexp_extract_all(text, '</turn>'))
      ELSE length(text) - length(translate(text, '\#<', '')) END AS escapes,
    CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE NULL END AS mark
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + mark + 2 + length(text) + escapes + 9)::BIGINT AS formatted_chars,
  true AS round_trip
FROM e GROUP BY conv_id"""

QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {"op1_chat_format": ORACLE}
