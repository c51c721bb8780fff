"""Chat formatting with a grammar round trip, in column functions only.

Template, for each turn: ``<|turn|>`` role ``\\n`` text ``<|end|>\\n``. The grammar has two control strings, ``<|turn|>`` and
``<|end|>``, which count as control strings wherever they stand, as they do for a tokenizer. The parser is deterministic: it
splits at every ``<|turn|>``, wants exactly one ``<|end|>`` and then a line end in each piece, takes the role up to the first
line end, and undoes escapes from the left. Anything else is no conversation.

Escapes: a backslash is written twice, ``<|`` as ``\\l|`` and, in roles, a line end as ``\\n``. Texts are first rendered as they
are; the rendered conversation is parsed again and compared with its source, and turns are escaped at level 1 (all of
the conversation) where it differs: where a text or role holds a control string or what reads as an escape. Level 1 leaves no
``<|`` in a text, and every backslash in pairs or before l or n, so it always parses back; ``identical`` says so for each
conversation. So no control string is ever left inside a text or role.

Rows are ordered by turn, then role and text; repeated rows are turns of their own. Null roles and texts are empty; rows
of a null conversation form one. A conversation is one record, so its turns meet in one row; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import read

BEGIN, END = "<|turn|>", "<|end|>\n"
LEARNT_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\l|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undo escapes from the left: between pairs of backslashes, ``\\l`` and ``\\n`` stand for their characters."""
    # split() takes a regular expression: two backslashes are four in it
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(plain, "\\")).otherwise(text)


def render(turns: Column, level: Column) -> Column:
    """The conversation as one text. turns: array of (role, text)."""
    one = lambda t: F.concat(
        F.lit(BEGIN), F.when(level > 0, escape_role(t.role)).otherwise(t.role), F.lit("\n"), F.when(level > 0, escape(t.text)).otherwise(t.text), F.lit(END)
    )
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Recover the turns: array of (role, text, raw), raw being the text as it stands in the format; null members where a piece
    is no turn, null where something stands before the first turn."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"<\|end\|>", -1)
        inner = F.when((F.size(parts) == 2) & (F.get(parts, F.lit(1)) == "\n") & F.contains(F.get(parts, F.lit(0)), F.lit("\n")), F.get(parts, F.lit(0)))
        role = F.substring_index(inner, "\n", 1)
        raw = F.substr(inner, F.length(role) + 2)
        return F.struct(unescape(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.when(F.get(pieces, F.lit(0)) == "", F.transform(F.slice(pieces, 2, F.size(pieces)), turn))


def conversations(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation with its turns in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select(F.col("conv").alias(conv_col), F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def _plain(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def format_chats(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """Per conversation: ``formatted``, ``level`` (0: as it was, 1: escaped), ``identical`` (it parses back to its source),
    ``parsed`` turns, and ``loss`` (begin and end, in characters of the formatted text, of each learnt role's text)."""
    chats = conversations(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    plain = chats.withColumn("first", render(F.col("turns"), F.lit(0)))
    tried = plain.withColumn("level", F.when(_plain(parse(F.col("first"))) == F.col("turns"), 0).otherwise(1))
    made = tried.withColumn("formatted", F.when(F.col("level") == 0, F.col("first")).otherwise(render(F.col("turns"), F.lit(1)))).drop("first")
    # of the turns as parsed: where each begins in the formatted text
    back = made.withColumn("parsed", parse(F.col("formatted"))).withColumn("heads", F.split("formatted", r"<\|end\|>\n", -1))
    whole = F.transform("heads", lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        end = acc.at + x.size
        span = F.array(F.struct((end - x.raw).cast("int").alias("begin"), end.cast("int").alias("end")))
        return F.struct((end + len(END)).cast("int").alias("at"), F.when(x.learnt, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    sized = F.zip_with("parsed", whole, lambda t, n: F.struct((t.role == learnt_role).alias("learnt"), F.length(t.raw).alias("raw"), n.alias("size")))
    known = F.filter(sized, lambda x: x.raw.isNotNull())
    return back.select(
        conv_col, "formatted", "level", F.coalesce(_plain(F.col("parsed")) == F.col("turns"), F.lit(False)).alias("identical"), _plain(F.col("parsed")).alias("parsed"),
        F.aggregate(known, start, add).spans.alias("loss"),
    )


#: A conversation whose texts hold control-like strings and escapes.
_HARD = "\\### Assistant: </turn> ok"

_LOOKS = r"""(role || chr(10) || text LIKE '%<|turn|>%' OR role || chr(10) || text LIKE '%<|end|>%' OR contains(role, chr(10)) OR contains(role, '\\') OR contains(text, '\\')
OR contains(role, '\l') OR contains(text, '\l') OR contains(role, '\n') OR contains(text, '\n'))"""
_MORE = r"(length({0}) - length(replace({0}, '\', ''))) + (length({0}) - length(replace({0}, '<|', '|')))"
#: The same rows in DuckDB: what conflicts is told by its strings there, not by parsing.
OP7_SQL = f"""WITH rows AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, turn, role, '{_HARD}' FROM (VALUES (0, 'user'), (1, '{LEARNT_ROLE}')) v(turn, role)),
levels AS (SELECT conv_id, max(CASE WHEN {_LOOKS} THEN 1 ELSE 0 END)::INTEGER AS level FROM rows GROUP BY conv_id),
sized AS (SELECT r.*, level, length(role) + length(text) + {len(BEGIN) + 1 + len(END)} + level * ({_MORE.format("role")} + {_MORE.format("text")} + length(role) - length(replace(role, chr(10), ''))) AS n
FROM rows r JOIN levels l ON r.conv_id IS NOT DISTINCT FROM l.conv_id),
joined AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNT_ROLE}'), '') AS loss, sum(n)::BIGINT AS formatted_chars, max(level) AS level FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, level, true AS identical FROM joined"""


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    # conversation -7 has the first two rows of a range, so no row leaves the JVM
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT_ROLE).alias("role"), F.lit(_HARD).alias("text"))
    chats = format_chats(rows.unionByName(extra))
    learnt = F.transform("loss", lambda s: unescape(F.substr("formatted", s.begin + 1, s.end - s.begin)))
    text = F.array_join(learnt, "")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"), F.sha2(text.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "level", "identical",
    )


