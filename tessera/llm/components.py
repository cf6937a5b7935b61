"""Connected components of a link table, with Spark joins only.

Each round every vertex hooks on its smallest neighbour if that is smaller and follows
the pointers four steps; the links are then rewritten between the vertices so reached. The
image of a connected set is connected, so rounds may stop short of a root: what is left
goes on in the next one. Links inside a tree vanish, so rounds are logarithmic in the number
of vertices, and two or three of them do for links of members to heads. A round writes two
tables; the labels of the rounds are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _links(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()


def _follow(up: DataFrame, to: DataFrame) -> DataFrame:
    """``up`` with its labels replaced by what ``to`` has for them."""
    further = to.select(F.col("u").alias("p"), F.col("p").alias("q"))
    return up.join(further, "p", "left").select("u", F.coalesce("q", "p").alias("p"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex with a link to another one; component is the smallest id reachable.

    Links may repeat, point either way or be loops. Null ends are left out. No links give an empty table.
    """
    left = cut(_links(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
    found: DataFrame | None = None
    while left.count():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        twice = _follow(up, up)
        up = cut(_follow(twice, twice))
        to_u, to_v = up.select("u", F.col("p").alias("ru")), up.select(F.col("u").alias("v"), F.col("p").alias("rv"))
        left = cut(_links(left.join(to_u, "u").join(to_v, "v"), "ru", "rv"))
        found = up if found is None else _follow(found, up)
    if found is None:
        return left.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.select(F.col("u").alias("id"), F.col("p").alias("component"))
