"""Starting centroids spread over the users: k-means++ as rounds of oversampling (k-means||).

A centroid is drawn in proportion to the squared distance from those there are. One draw at a time
would be k passes over all users; instead each of a few rounds draws about ``factor * k`` users at
once. Every user then counts for its nearest candidate, and plain weighted k-means++ picks ``k`` of
the candidates. Draws are hashes of user, seed and round, so a run gives the same start every time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.ratings import rated
from tablewise.shared import stored

ROUNDS, FACTOR = 5, 2
_DIGITS = 13  # hexadecimal digits of a hash that make a number between 0 and 1

# candidates' cells and their number to (user_id, cluster_id, distance) of all users
Assign = Callable[[DataFrame, int], DataFrame]


def draw(user: Column, seed: int, label: str) -> Column:
    """A number above 0 and below 1 from the user's hash."""
    digits = F.substring(F.md5(F.concat_ws("|", user, F.lit(str(seed)), F.lit(label))), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**_DIGITS))


def _draw(user: str, seed: int, label: str) -> float:
    digits = hashlib.md5(f"{user}|{seed}|{label}".encode()).hexdigest()[:_DIGITS]
    return (int(digits, 16) + 0.5) / 16**_DIGITS


def _cells(ratings: DataFrame, numbered: DataFrame, number: str) -> DataFrame:
    """Vectors of a few users as centroid cells."""
    found = ratings.where(rated()).join(F.broadcast(numbered), "user_id")
    return found.select(F.col(number).alias("cluster_id"), "gmap_id", F.col("rating").cast("double").alias("value"))


def candidates(
    ratings: DataFrame, users: DataFrame, k: int, seed: int, assign: Assign, rounds: int = ROUNDS, factor: int = FACTOR
) -> tuple[DataFrame, DataFrame]:
    """``(candidate, user_id)``, about ``rounds * factor * k`` rows, and every user's nearest candidate
    as ``(user_id, candidate, distance)``."""
    ids = users.select("user_id")
    first = ids.orderBy(draw(F.col("user_id"), seed, "0"), "user_id").limit(1)
    chosen = stored(first.select(F.lit(0).alias("candidate"), "user_id"), "candidates")
    known = chosen.count()
    near = None
    fresh, n_new = chosen, known
    for turn in range(1, rounds + 2):
        if n_new:
            numbered = fresh.select((F.col("candidate") - (known - n_new)).alias("number"), "user_id")
            cells = stored(_cells(ratings, numbered, "number"), "candidate-cells")
            found = assign(cells, n_new).select(
                "user_id", F.struct("distance", (F.col("cluster_id") + (known - n_new)).alias("candidate")).alias("new")
            )
            if near is None:
                near = found.select("user_id", "new.*")
            else:
                old = near.select("user_id", F.struct("distance", "candidate").alias("old"))
                near = old.join(found, "user_id").select("user_id", F.least("old", "new").alias("n")).select("user_id", "n.*")
            near = stored(near, "near")
        if turn > rounds:
            break
        total = near.agg(F.sum("distance")).first()[0] if near is not None else 0.0
        if not total:
            break
        share = draw(F.col("user_id"), seed, str(turn)) * F.lit(total)
        picked = near.where(share < F.lit(float(factor * k)) * F.col("distance")).select("user_id")
        # the window runs over the few drawn users
        place = F.row_number().over(Window.orderBy("user_id")) - 1 + known
        fresh = stored(picked.select(place.alias("candidate"), "user_id"), "candidates")
        n_new = fresh.count()
        known += n_new
        chosen = chosen.unionByName(fresh)
    return chosen, near


def reduced(users: list[str], weights: np.ndarray, squares: np.ndarray, k: int, seed: int) -> list[int]:
    """Weighted k-means++ over the candidates: places of the ``k`` chosen ones, in the order of choice.

    An exponential number with rate weight times squared distance is drawn for each; the least wins.
    Candidates that stand on a chosen one come last, in their order.
    """
    near = np.ones(len(users))
    out: list[int] = []
    for turn in range(min(k, len(users))):
        u = np.array([_draw(user, seed, f"pick {turn}") for user in users])
        with np.errstate(divide="ignore"):
            race = np.where(near > 0, -np.log(u) / (weights * near), np.inf)
        left = np.setdiff1d(np.arange(len(users)), out)
        best = int(left[np.argmin(race[left])])
        near = squares[best] if not out else np.minimum(near, squares[best])
        out.append(best)
    return out


def plus_plus_start(
    ratings: DataFrame, users: DataFrame, k: int, seed: int, assign: Assign, rounds: int = ROUNDS, factor: int = FACTOR
) -> DataFrame:
    """Centroid cells of ``k`` users.

    Only the candidates, a multiple of ``k``, come to the driver: their weights and the products of
    their vectors. With fewer candidates than ``k`` other users follow, by hash; with fewer users than
    ``k`` there are as many centroids as users.
    """
    spark = ratings.sparkSession
    chosen, near = candidates(ratings, users, k, seed, assign, rounds, factor)
    names = {r.candidate: r.user_id for r in chosen.collect()}
    m = len(names)
    if not m:
        return spark.createDataFrame([], "cluster_id int, gmap_id string, value double")
    weights = np.zeros(m)
    for r in near.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).collect():
        weights[r.candidate] = r.n
    cells = stored(_cells(ratings, chosen, "candidate"), "candidate-cells")
    other = cells.select(F.col("cluster_id").alias("b"), "gmap_id", F.col("value").alias("other"))
    products = cells.join(other, "gmap_id").groupBy(F.col("cluster_id").alias("a"), "b").agg(
        F.sum(F.col("value") * F.col("other")).alias("dot")
    )
    dots = np.zeros((m, m))
    for r in products.where("a <= b").collect():
        dots[r.a, r.b] = dots[r.b, r.a] = r.dot
    norms = np.diag(dots)
    squares = np.round(norms[:, None] + norms[None, :] - 2 * dots, 9)
    np.fill_diagonal(squares, 0)
    picked = [names[p] for p in reduced([names[i] for i in range(m)], weights, squares, k, seed)]
    if len(picked) < k:
        rest = users.select("user_id").where(~F.col("user_id").isin(picked))
        picked += [r[0] for r in rest.orderBy(draw(F.col("user_id"), seed, "0"), "user_id").limit(k - len(picked)).collect()]
    numbered = spark.createDataFrame(list(enumerate(picked)), "number int, user_id string")
    return _cells(ratings, numbered, "number")
