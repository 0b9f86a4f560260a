"""Chat formatting with a grammar round trip (operator 2), in DataFrame functions only.

Grammar::

    conversation := turn*
    turn         := "<turn " level " " role ">" body "</turn>" newline

A body holds neither "</turn>" nor "<turn ". Texts are first rendered as they are (level 0); the
rendered turn is parsed again, and where the parser does not give back the same role and text, the
content is escaped: level 1 breaks the two control strings with a backslash, level 2 replaces every
backslash and "<" (always reversible). The level stands in the turn's mark, so the parser knows how
to undo it. The whole conversation is then parsed once more and compared with its source; a
difference raises an error.

Edge cases: null text or role = empty; a null turn sorts first; equal turns are ordered by role and
text, repeated rows stay; null conv_id is one conversation; an empty table gives no rows. Only
conv_id, turn, role and text are read. A conversation is one row by definition, so its turns meet
in one task; rendering, escaping and the first round trip happen before that, turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLOSE, OPEN = "</turn>", "<turn "


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        return _swap(text, (CLOSE, "<\\/turn>"), (OPEN, "<\\turn "))
    return _swap(text, ("\\", "\\b"), ("<", "\\l"))


def unescape(body: Column, level: Column) -> Column:
    first = _swap(body, ("<\\/turn>", CLOSE), ("<\\turn ", OPEN))
    return F.when(level == "0", body).when(level == "1", first).otherwise(_swap(body, ("\\l", "<"), ("\\b", "\\")))


def escape_role(role: Column) -> Column:
    return _swap(role, ("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def unescape_role(role: Column) -> Column:
    return _swap(role, ("\\l", "<"), ("\\g", ">"), ("\\b", "\\"))


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(f"{OPEN}{level} "), escape_role(role), F.lit(">"), escape(text, level), F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null where it does not follow the grammar."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column, i: Column) -> Column:
        own = F.when(i == 0, piece).when(F.startswith(piece, F.lit("\n")), F.substr(piece, F.lit(2)))
        mark = r"(?s)\A<turn ([012]) ([^<>]*)>(.*)\z"
        body = F.regexp_extract(own, mark, 3)
        good = own.rlike(mark) & ~F.contains(body, F.lit(OPEN))
        return F.when(good, F.struct(unescape_role(F.regexp_extract(own, mark, 2)).alias("role"), unescape(body, F.regexp_extract(own, mark, 1)).alias("text")))

    return F.when(F.element_at(pieces, -1) == "\n", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn))


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_mask (for each turn the span of its
    body in code points, end exclusive, and whether it is trained on)."""
    source = F.array(F.struct("role", "text"))
    turns = (
        conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("rendered", F.when(parse(render(F.col("role"), F.col("text"), 0)) == source, render(F.col("role"), F.col("text"), 0)).when(parse(render(F.col("role"), F.col("text"), 1)) == source, render(F.col("role"), F.col("text"), 1)).otherwise(render(F.col("role"), F.col("text"), 2)))
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    head = F.length(F.lit(f"{OPEN}0 ")) + F.length(escape_role(F.col("role"))) + 1
    placed = (
        turns.withColumn("at", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long")))
        .withColumn("place", F.row_number().over(here))
        .withColumn("start", F.col("at") + head)
        .withColumn("end", F.col("at") + F.length("rendered") - len(CLOSE) - 1)
    )
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "rendered", "start", "end"))).alias("turns"))
    out = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), (t["role"] == trained_role).alias("trained"))).alias("loss_mask"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    same = parse(F.col("formatted")) == F.col("source")
    return out.select("conv_id", "n_turns", F.when(F.coalesce(same, F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a chat does not survive its round trip"))).alias("formatted"), "loss_mask")


def read_back(chats: DataFrame) -> DataFrame:
    """The turns of the output of `format_chats`, from its text and mask alone: conv_id, formatted_chars, place, role, text, loss_text.

    `loss_text` is what the mask's span covers, unescaped. Spans count code points from the start of the
    conversation; each turn's piece knows where it begins there by a running sum, so every character is
    looked at once. A span that leaves its piece, or a mask of another number of turns, is an error.
    """
    pieces = F.split("formatted", CLOSE, -1)
    chars = F.length("formatted").cast("long").alias("formatted_chars")
    each = chats.select("conv_id", chars, F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss_mask").alias("mask"))).alias("place", "t"), F.size("loss_mask").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("t.piece").cast("long") + len(CLOSE)).over(before), F.lit(0).cast("long"))
    placed = each.withColumn("at", at).where("place < n or t.mask is not null or t.piece <> '\n'")
    start, end = F.col("t.mask.start") - F.col("at"), F.col("t.mask.end") - F.col("at")
    fits = F.coalesce((start >= 0) & (start <= end) & (end <= F.length("t.piece")), F.lit(False))
    mark = r"(?s)\A\n?<turn ([012]) ([^<>]*)>(.*)\z"
    level = F.regexp_extract("t.piece", mark, 1)
    covered = F.substring(F.col("t.piece"), (start + 1).cast("int"), (end - start).cast("int"))
    return placed.select(
        "conv_id",
        "formatted_chars",
        "place",
        unescape_role(F.regexp_extract("t.piece", mark, 2)).alias("role"),
        unescape(F.regexp_extract("t.piece", mark, 3), level).alias("text"),
        F.when(fits, F.when(F.col("t.mask.trained"), unescape(covered, level)).otherwise("")).otherwise(F.raise_error(F.lit("a loss span leaves its turn"))).alias("loss_text"),
    )


def digest(chats: DataFrame) -> DataFrame:
    """What the output of `format_chats` says when it is read back: hashes of turns and of the text under the loss mask."""
    whole = read_back(chats).groupBy("conv_id").agg(F.first("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("place", "role", "text", "loss_text"))).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("loss_text", F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose two texts are full of control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
levelled AS (
  SELECT *, CASE WHEN NOT contains(t, '</turn>') AND NOT contains(t, '<turn ') THEN 0
    WHEN NOT contains(t, '<\/turn>') AND NOT contains(t, '<\turn ') THEN 1 ELSE 2 END AS level
  FROM said),
sized AS (
  SELECT *, CASE level WHEN 0 THEN length(t)
      WHEN 1 THEN length(replace(replace(t, '</turn>', '<\/turn>'), '<turn ', '<\turn '))
      ELSE length(replace(replace(t, '\', '\b'), '<', '\l')) END AS body,
    length(replace(replace(replace(r, '\', '\b'), '<', '\l'), '>', '\g')) AS head
  FROM levelled)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn 0 ') + head + 1 + body + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
