"""Joining results per distinct text back to a log in which some texts are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000


def attach_to_log(
    log: DataFrame,
    texts: DataFrame,
    per_text: DataFrame,
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``log`` rows with the rows of ``per_text`` for their text.

    ``log`` and ``texts`` carry ``text_id``; ``texts`` also the number of uses. A text used more
    than ``rows_per_salt`` times is spread over several salts, on its own rows only.
    Their number grows with the log, so whether to broadcast them is left to adaptive execution.
    """
    salts = F.ceil(F.col("uses") / rows_per_salt).cast("int")
    hot = texts.filter(F.col("uses") > rows_per_salt).select("text_id", salts.alias("salts"))
    # over all columns, as query ids may repeat or be null
    spread = F.pmod(F.xxhash64(*log.columns), F.col("salts")).cast("int")
    salted_log = log.join(hot, "text_id", "left").withColumn("salt", F.coalesce(spread, F.lit(0)))
    keyed = texts.select("text_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(per_text, "text_id")
    return salted_log.join(keyed, ["text_id", "salt"], how).drop("salt", "salts")
