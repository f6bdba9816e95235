"""Chat formatting with a grammar round trip (operator 5).

Grammar of a rendered conversation::

    conversation := turn*
    turn         := <|im_start|> role LF body <|im_end|> LF
    body         := text without a control string

Every turn is rendered plainly, reparsed, and compared with its source.  Where
the parser does not give the source back, the conflicting part is escaped and
the turn is rendered and compared again; an escaped part always comes back, and
a turn that did not would raise.  The finished conversation is reparsed as a
whole in the same way.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape_text(c: Column) -> Column:
    """One more backslash inside every ``<\\...|``: afterwards no ``<|`` is left."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("|", "%7C")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_role(c: Column) -> Column:
    for a, b in (("%7C", "|"), ("%0A", "\n"), ("%25", "%")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; null where the grammar does not hold."""
    pieces = F.split(rendered, r"<\|im_end\|>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    # every turn but the first follows the LF that ends the turn before it
    bare = F.transform(turns, lambda p, i: F.when(i == 0, p).when(p.startswith("\n"), F.substr(p, F.lit(2))))
    head = F.lit(len(START) + 1)

    def turn(p: Column) -> Column:
        rest = F.when(p.startswith(START), F.substr(p, head))
        cut = F.instr(rest, "\n")
        role, body = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut + 1)
        fits = (cut > 0) & ~role.contains(START) & ~body.contains(START)
        return F.when(fits, F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text")))

    out = F.transform(bare, turn)
    whole = (F.element_at(pieces, -1) == F.when(F.size(pieces) > 1, F.lit("\n")).otherwise(F.lit(""))) & ~F.exists(out, lambda t: t.isNull())
    return F.when(whole, out)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Render rows (conv_id, turn, role, text) as one row per conversation.

    Returns conv_id, n_turns, formatted and loss_mask: the (start, length)
    spans, in code points from 0, of the assistant bodies in ``formatted``.
    Turns stand by turn number, then role and text (null turns first; repeated
    rows are separate turns).  Null role or text is empty; a null conv_id is a
    conversation of its own.  A conversation is one row, as its digest is of
    its whole text.  Empty input gives no rows; extra columns are ignored.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("plain", parse(render(F.col("role"), F.col("text"))))
    back = F.coalesce(F.col("plain") == source, F.lit(False))
    # what did not come back is escaped: role and body each, if it is the one that conflicts
    role_ok = unescape_role(F.col("role")) == F.col("role")
    role_ok = role_ok & ~F.col("role").contains("\n") & ~F.col("role").contains(START) & ~F.col("role").contains(END)
    rows = (rows.withColumn("header", F.when(back | role_ok, F.col("role")).otherwise(escape_role(F.col("role"))))
            .withColumn("body", F.when(back, F.col("text")).when(
                (unescape_text(F.col("text")) == F.col("text")) & ~F.col("text").contains(START) & ~F.col("text").contains(END),
                F.col("text")).otherwise(escape_text(F.col("text"))))
            .withColumn("shown", render(F.col("header"), F.col("body"))))
    again = F.when(back, F.lit(True)).otherwise(F.coalesce(parse(F.col("shown")) == source, F.lit(False)))
    rows = rows.withColumn("shown", F.when(again, F.col("shown")).otherwise(
        F.raise_error(F.concat(F.lit("turn does not come back: conversation "), F.col("conv_id").cast("string")))))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (rows.withColumn("no", F.row_number().over(order))
            .withColumn("upto", F.sum(F.char_length("shown")).over(order.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("start", F.col("upto") - len(END) - 1 - F.char_length("body")))
    turns = F.array_sort(F.collect_list(F.struct("no", "role", "text", "shown", "start", F.char_length("body").cast("long").alias("length"))))
    made = rows.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.expr("array_join(transform(t, x -> x.shown), '')").alias("formatted"),
        F.expr(f"transform(filter(t, x -> x.role = '{LOSS_ROLE}'), x -> struct(x.start as start, x.length as length))").alias("loss_mask"),
        F.expr("transform(t, x -> struct(x.role as role, x.text as text))").alias("turns"))
    whole = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    return made.withColumn("formatted", F.when(whole, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not come back: "), F.col("conv_id").cast("string"))))).drop("turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """Add what the rendered text itself says: turns (parsed) and loss_text (under the mask, unescaped)."""
    piece = F.transform("loss_mask", lambda m: unescape_text(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_text", F.array_join(piece, ""))


def digest(back: DataFrame) -> DataFrame:
    """Digest columns of :func:`read_back`'s rows."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
