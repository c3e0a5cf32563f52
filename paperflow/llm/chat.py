"""Chat formatting by a grammar round trip.

A turn is rendered as `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. The rendering is parsed
again by a fixed grammar; a turn that does not come back as it was is rendered with its conflicting content escaped.
Escaping adds one backslash after every `<` that, with any backslashes between, stands before `|`; the parser takes one
away again. So an escaped text holds no control string and always comes back, and ordinary texts are left as they are.
A role keeps its line breaks as `\\n` and its backslashes doubled, for the header is one line.

Cases: null text or role is empty. Turns are ordered by turn (null first), then role and text. Repeated rows are turns
of their own. Rows without conversation id form one conversation with a null id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo the doubled backslashes and the line breaks together, then the control strings."""
    marked = F.replace(role, F.lit("\\\\"), F.lit("\n"))  # a header holds no line break, so it can stand in for a while
    broken = F.split(marked, "\n", -1)
    return unescape_text(F.array_join(F.transform(broken, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation, an array of (role, text).

    Every start mark opens a turn; a turn is a line with the role, a text and one end mark with its line break. A turn
    that is not of this form comes back with a null text.
    """
    split = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(split, F.lit(2), F.size(split))
    text = lambda x: F.regexp_extract(x, r"(?s)\A[^\n]*\n(.*)<\|im_end\|>\n\z", 1)
    whole = lambda x: x.endswith(f"{END}\n") & ~text(x).contains(END)
    return F.transform(pieces, lambda x: F.struct(
        unescape_role(F.regexp_extract(x, r"\A([^\n]*)\n", 1)).alias("role"), F.when(whole(x), unescape_text(text(x))).alias("text")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and formatted, one row per conversation, from rows of (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # A turn alone tells whether it survives: what it holds can only end or open turns inside its own rendering.
    alone = rendered(F.col("role"), F.col("text"))
    back = plain.select("*", alone.alias("alone"), parsed(alone).alias("back"))
    first = F.get("back", F.lit(0))
    same = (F.size("back") == 1) & first["role"].eqNullSafe(F.col("role")) & first["text"].eqNullSafe(F.col("text"))
    escaped = rendered(escape_role(F.col("role")), escape_text(F.col("text")))
    plain = back.select("conv_id", "turn", "role", "text", F.when(same, F.col("alone")).otherwise(escaped).alias("out"))
    gathered = plain.select("conv_id", F.struct("turn", "role", "text", "out").alias("t"))
    return gathered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (recovered), loss_text (the assistant's texts, unescaped, end to end)."""
    return formatted.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns")).select("*", F.array_join(F.transform(
        F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "").alias("loss_text"))
