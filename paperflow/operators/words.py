"""Word rows of an OCR engine to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import block, neighbour, running_count


def words_to_lines(words: DataFrame, key: str = "page_ref", order: str = "row_no", block_size: int = 65_536) -> DataFrame:
    """Join words of one block, paragraph and line while the gap to the word before is at most 1.5 word heights.

    Rows of another level or without text are dropped before anything else; confidence is clipped to 0..1.
    """
    clean = (words.where((F.col("level") == 5) & (F.trim("text") != "")).withColumns({
        "text": F.trim("text"), "confidence": F.least(F.greatest(F.col("conf") / 100, F.lit(0.0)), F.lit(1.0)),
        "right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height")}))
    near = neighbour(clean, [key], [order], block(order, block_size), ["block", "par", "line", "right"], "_b")
    same = (F.col("_b.block") == F.col("block")) & (F.col("_b.par") == F.col("par")) & (F.col("_b.line") == F.col("line"))
    starts = ~F.coalesce(same, F.lit(False)) | (F.col("left") - F.col("_b.right") > 1.5 * F.col("height"))
    marked = running_count(near.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int")), [key], [order], block(order, block_size), F.col("_starts"), "line_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda w: w["text"]), " ")
    return marked.groupBy(key, "line_no").agg(text.alias("text"), F.min("confidence").alias("confidence"), F.min("left").alias("x0"), F.min("top").alias("y0"),
                                              F.max("right").alias("x1"), F.max("bottom").alias("y1"))
