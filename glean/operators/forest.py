"""Scores of a fitted forest for whole batches of rows (K8), equal to Spark ML's; forests grown from all rows (K4).

Spark ML walks every tree node by node for each row; with the reference's 800 trees nearly every step misses the
processor's caches.  Here a batch of rows passes all trees at once:

* A feature is split at a bounded number of thresholds (``maxBins`` - 1), so a value counts by its place among them.
* For each place, one mask a tree holds the leaves that the splits of that feature leave open: a split that sends the
  value right closes the leaves on its left.
* The conjunction of a row's masks has the row's leaf as its first open bit, leaves numbered from left to right.

Nothing depends on how often values come, and a row costs the same whatever it holds.  The shares of the leaves are added
up tree after tree and divided by their sum, in Spark ML's order, so scores are the same doubles.  A null or NaN feature
goes right everywhere, as with ``handleInvalid="keep"``.

Spark ML grows its trees level by level and keeps them on the driver: with 800 trees of depth 20 it holds for a few thousand
rows.  ``grown`` counts all rows by their bins instead, and a task grows whole trees from these counts (``Grown``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.session import scratch_path

MAX_MASK_BYTES = 64 << 20  # the masks go to every executor; larger forests are left to Spark ML
ROWS = 32  # rows of one step: their masks stay in the processor's cache
WORD = 64


class Masks:
    """Thresholds, masks (bins, words, trees) and class shares of a two-class forest."""

    def __init__(self, nodes, n_features: int) -> None:
        """``nodes``: tree, id, left, right, feature, threshold and stats; ids of a tree in preorder."""
        import numpy as np

        nodes = nodes.sort_values(["tree", "id"])
        trees = [t for _, t in nodes.groupby("tree", sort=True)]
        leaves = int((nodes["left"] < 0).groupby(nodes["tree"]).sum().max())
        self.words = -(-leaves // WORD)
        inner = nodes[nodes["left"] >= 0]
        self.thresholds = [np.unique(inner["threshold"][inner["feature"] == f].to_numpy(np.float64)) for f in range(n_features)]
        full = np.uint64(2**WORD - 1)
        self.masks = [np.full((len(t) + 1, self.words, len(trees)), full) for t in self.thresholds]
        self.shares = np.zeros((2, len(trees), self.words * WORD))
        for n, tree in enumerate(trees):
            self._add(n, tree)
        for m in self.masks:  # a value right of one threshold is right of all smaller ones
            np.bitwise_and.accumulate(m, axis=0, out=m)
        self.offset = np.arange(len(trees)) * (self.words * WORD)

    def _add(self, n: int, tree) -> None:
        import numpy as np

        left, right, feature, threshold = (tree[c].tolist() for c in ("left", "right", "feature", "threshold"))
        place = {i: at for at, i in enumerate(tree["id"].tolist())}
        before = np.concatenate(([0], np.cumsum(tree["left"].to_numpy() < 0))).tolist()  # leaves before a node
        for at, (a, b) in enumerate(zip(left, right)):
            if a < 0:
                continue
            f = feature[at]
            bin_ = int(np.searchsorted(self.thresholds[f], threshold[at])) + 1
            closed = (1 << before[place[b]]) - (1 << before[place[a]])
            for w in range(self.words):
                self.masks[f][bin_, w, n] &= np.uint64(~(closed >> (w * WORD)) & (2**WORD - 1))
        stats = np.array([s for s, a in zip(tree["stats"], left) if a < 0], np.float64)
        total = stats.sum(axis=1)
        share = np.divide(stats, total[:, None], out=np.zeros_like(stats), where=total[:, None] != 0)
        self.shares[:, n, : len(share)] = share.T

    def scores(self, columns):
        """Share of class 1 for every row of the feature columns (float64, NaN where missing)."""
        import numpy as np

        bins = [np.searchsorted(t, c, side="left") for t, c in zip(self.thresholds, columns)]
        out = np.zeros(len(bins[0]))
        room = np.empty((2, ROWS, *self.masks[0].shape[1:]), np.uint64)
        for lo in range(0, len(out), ROWS):
            part = slice(lo, lo + ROWS)
            open_, more = room[:, : len(out[part])]
            np.take(self.masks[0], bins[0][part], axis=0, out=open_, mode="clip")
            for m, b in zip(self.masks[1:], bins[1:]):
                np.take(m, b[part], axis=0, out=more, mode="clip")
                open_ &= more
            np.subtract(open_, np.uint64(1), out=more)
            first = np.bitwise_count(~open_ & more)  # closed leaves before the first open one of a word
            leaf = first[:, 0].astype(np.int64)
            for w in range(1, self.words):
                leaf += first[:, w] * (leaf == w * WORD)
            leaf += self.offset
            # Running sums add tree after tree; a plain sum would add in pairs.
            no, yes = (np.cumsum(s.ravel()[leaf], axis=1)[:, -1] for s in self.shares)
            total = no + yes
            out[part] = np.divide(yes, total, out=np.zeros_like(yes), where=total != 0)
        return out


def masks(model, n_features: int) -> Masks | None:
    """Masks of a fitted Spark ML forest, read from its saved nodes; None where they do not apply."""
    weights = getattr(model, "treeWeights", None)
    if weights is None or model.numClasses != 2 or set(weights) != {1.0}:
        return None
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    n, split = F.col("nodeData"), F.col("nodeData.split")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        split["numCategories"].alias("categories"), n["impurityStats"].alias("stats"),
    )
    inner = nodes.filter("left >= 0")
    bins = inner.select("feature", "threshold").distinct().count() + n_features
    most = nodes.filter("left < 0").groupBy("tree").count().agg(F.max("count")).first()[0]
    size = bins * len(weights) * 8 * -(-most // WORD)
    if size > MAX_MASK_BYTES or not inner.filter("categories >= 0").isEmpty():
        return None
    return Masks(nodes.toPandas(), n_features)


def score(m: Masks, columns: list[Column]) -> Column:
    """Probability of class 1 from the feature columns."""
    import pandas as pd

    def run(*parts):
        return pd.Series(m.scores([p.to_numpy("float64", na_value=float("nan")) for p in parts]))

    run.__annotations__ = {"parts": pd.Series, "return": pd.Series}  # the module's are strings
    return F.pandas_udf(run, "double")(*[c.cast("double") for c in columns])


# --- K4: growing a forest on all rows --------------------------------------------
BINS, BITS = 32, 5  # as Spark ML's maxBins; a row's bins stand in one number
MAX_FEATURES = 63 // BITS
SHARE = 1 << 40  # shares of leaves are added as whole numbers: the same sum in any order
SCORE_CHUNK = 1 << 16


def cuts(df: DataFrame, cols: list[str]):
    """At most ``BINS`` - 1 ascending thresholds a column, from all its finite values: between neighbours
    where there are at most ``BINS`` different values, else the exact quantiles."""
    import numpy as np

    from glean.operators import risk as R

    whole = [F.col(c).cast("double") for c in cols]
    v = df.select(*[F.when(F.abs(x) < float("inf"), x).alias(c) for x, c in zip(whole, cols)])  # NaN is above infinity
    many = v.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    out, rest = {}, []
    for c in cols:
        found = []
        if many[c] <= 2 * BINS:
            found = sorted(r[0] for r in v.filter(F.col(c).isNotNull()).select(c).distinct().limit(BINS + 1).collect())
        if len(found) > BINS or many[c] > 2 * BINS:
            rest.append(c)
            continue
        middle = [(a, b, a / 2 + b / 2) for a, b in zip(found, found[1:])]
        out[c] = np.array([m if a <= m < b else a for a, b, m in middle], np.float64)
    if rest:
        points = [i / BINS for i in range(1, BINS)]
        found = {c: set() for c in rest}
        for r in R.exact_quantiles(R.unpivot(v.select(*rest), rest), points).collect():
            found[r["column_name"]].add(r["quantile"])
        out.update((c, np.array(sorted(x), np.float64)) for c, x in found.items())
    return [out[c] for c in cols]


def _code(thresholds, columns: list[Column]) -> Column:
    """The bins of a row in one number.  A null or NaN is in the last bin."""
    import pandas as pd

    def run(*parts):
        import numpy as np

        code = np.zeros(len(parts[0]), np.int64)
        for i, (t, p) in enumerate(zip(thresholds, parts)):
            at = np.searchsorted(t, x := p.to_numpy("float64", na_value=float("nan")), side="left")
            code |= np.where(np.isnan(x), BINS - 1, at) << (BITS * i)
        return pd.Series(code)

    run.__annotations__ = {"parts": pd.Series, "return": pd.Series}  # the module's are strings
    return F.pandas_udf(run, "bigint")(*[c.cast("double") for c in columns])


class Tree:
    """One tree, level after level.  ``bins`` (rows, features), ``counts`` (2, rows): rows of each class with these bins.

    As Spark ML's: every row is drawn Poisson(1) times, a node tries ``tries`` random features, splits by gini and
    leaves with the same prediction are joined.  The draws of equal rows are one Poisson draw of their number.
    """

    def __init__(self, bins, counts, weights, depth: int, tries: int, rnd) -> None:
        import numpy as np

        k = rnd.poisson(counts).astype(np.float64)
        rows = np.flatnonzero(k.sum(0))
        flat, width = bins.ravel(), bins.shape[1]
        begin, k = rows * width, k[:, rows]
        w = np.asarray(weights, np.float64)
        total, at = k.sum(1)[None], np.zeros(len(rows), np.int64)
        self.levels = []  # of each node: feature (-1: a leaf), bin, rank among the split ones, class counts, gain
        for level in range(depth + 1):
            n = len(total)
            feature, bin_, best = np.full(n, -1, np.int8), np.zeros(n, np.uint8), np.zeros(n)
            rank = np.full(n, -1, np.int64)
            self.levels.append([feature, bin_, rank, total, best])
            mixed = np.flatnonzero((total > 0).all(1)) if level < depth else []
            if not len(mixed):
                break
            rank[mixed] = np.arange(len(mixed))
            at = rank[at]
            keep = at >= 0
            at, begin, k = at[keep], begin[keep], k[:, keep]
            t, m = total[mixed], len(mixed)
            tried = np.argsort(rnd.random((m, width)), axis=1)[:, :tries].astype(np.int64)
            impure, tw = _gini(t[:, 0] * w[0], t[:, 1] * w[1]), t @ w
            gains, chosen, where = np.zeros(m), np.full(m, -1, np.int8), np.zeros(m, np.uint8)
            for j in range(tries):
                key = at * BINS + flat[begin + tried[at, j]]
                c0, c1 = (np.bincount(key, x, m * BINS) for x in k)
                e = np.flatnonzero(c0 + c1)
                of = e // BINS
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                left = []
                for c in (c0[e], c1[e]):
                    upto = np.cumsum(c)  # whole numbers: exact
                    left.append(upto - (upto - c)[first][of])
                l0, l1 = left[0] * w[0], left[1] * w[1]
                r0, r1 = (t[of, 0] - left[0]) * w[0], (t[of, 1] - left[1]) * w[1]
                gain = impure[of] - ((l0 + l1) * _gini(l0, l1) + (r0 + r1) * _gini(r0, r1)) / tw[of]
                gain[np.append(first[1:], len(e)) - 1] = 0.0  # nothing is right of the last bin
                top = np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain == top[of])[::-1]
                place = np.empty(m, np.int64)
                place[of[hit]] = e[hit]  # the first of equals stays
                more = top > np.maximum(gains, 1e-12)
                gains[more], where[more], chosen[more] = top[more], (place % BINS)[more], tried[more, j]
            split = chosen >= 0
            rank[:] = -1
            rank[mixed[split]] = np.arange(int(split.sum()))
            feature[mixed], bin_[mixed], best[mixed] = chosen, where, gains
            new = np.cumsum(split) - 1
            keep = split[at]
            at, begin, k = at[keep], begin[keep], k[:, keep]
            right = flat[begin + chosen[at].astype(np.int64)] > where[at]
            at = 2 * new[at] + right
            total = np.stack([np.bincount(at, x, 2 * int(split.sum())) for x in k], axis=1)
            if not split.any():
                break
        self._join(w)
        self.w, self.width = w, width

    def _join(self, w) -> None:
        import numpy as np

        below = None  # of the level below: is a leaf, prediction
        for feature, _, rank, total, _ in reversed(self.levels):
            said = (total[:, 1] * w[1] > total[:, 0] * w[0]).astype(np.int8)
            inner = np.flatnonzero(feature >= 0)
            if len(inner):
                leaf, told = (x.reshape(-1, 2) for x in below)
                same = (leaf.all(1) & (told[:, 0] == told[:, 1]))[rank[inner]]
                said[inner[same]] = told[rank[inner[same]], 0]
                feature[inner[same]] = -1
            below = feature < 0, said

    def shares(self, bins):
        """Share of class 1 in each row's leaf, as a whole number of ``SHARE``."""
        import numpy as np

        out = np.zeros(len(bins), np.int64)
        rows, at = np.arange(len(bins)), np.zeros(len(bins), np.int64)
        for feature, bin_, rank, total, _ in self.levels:
            yes, all_ = total[:, 1] * self.w[1], total @ self.w
            share = np.rint(np.divide(yes, all_, out=np.zeros_like(yes), where=all_ > 0) * SHARE).astype(np.int64)
            f = feature[at].astype(np.int64)
            out[rows[f < 0]] = share[at[f < 0]]
            rows, at, f = rows[f >= 0], at[f >= 0], f[f >= 0]
            if not len(rows):
                break
            at = 2 * rank[at] + (bins[rows, f] > bin_[at])
        return out

    def importances(self):
        """Weighted gains by feature, adding up to 1 (0 where nothing is split)."""
        import numpy as np

        out, reached = np.zeros(self.width), np.ones(1, bool)
        for feature, _, rank, total, gain in self.levels:
            inner = np.flatnonzero((feature >= 0) & reached)
            if not len(inner):
                break
            np.add.at(out, feature[inner], gain[inner] * (total[inner] @ self.w))
            reached = np.zeros(2 * (int(rank.max()) + 1), bool)
            reached[2 * rank[inner]] = reached[2 * rank[inner] + 1] = True
        return out / out.sum() if out.sum() > 0 else out


def _gini(a, b):
    import numpy as np

    n = a + b
    return np.divide(2 * a * b, n * n, out=np.zeros_like(n), where=n > 0)


GROWN = "chunk int, part int, codes binary, sums binary"


class Grown:
    """A forest of all training rows: thresholds, rows counted by their bins, and weights of the classes.

    Trees are neither stored nor collected.  A task grows some of them, one after the other, from the counted rows,
    and uses each on the counted rows to score; what leaves it are sums.  A tree depends on the counts, the seed and its number alone.
    """

    def __init__(self, path: str, thresholds, cols: list[str], weights, trees: int, depth: int, seed: int) -> None:
        self.path, self.thresholds, self.cols, self.weights = path, thresholds, cols, weights
        self.trees, self.depth, self.seed = trees, depth, seed

    def _grown(self, asked: DataFrame | None) -> DataFrame:
        spark = SparkSession.getActiveSession()
        parts = min(self.trees, 4 * spark.sparkContext.defaultParallelism)
        counted = spark.read.parquet(self.path).select("code", "no", "yes")
        rows = counted if asked is None else counted.unionByName(asked.select("code", F.lit(None).cast("bigint").alias("no"), F.lit(None).cast("bigint").alias("yes")))

        def pack(batches):
            import pandas as pd

            for pdf in batches:
                for learn, part in ((True, pdf[pdf["no"].notna()]), (False, pdf[pdf["no"].isna()])):
                    if len(part):
                        cols = [part[c].fillna(0).to_numpy("int64").tobytes() for c in ("code", "no", "yes")]
                        yield pd.DataFrame([[learn, *cols]], columns=["learn", "code", "no", "yes"])

        packed = rows.mapInPandas(pack, "learn boolean, code binary, no binary, yes binary")
        dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionByRange(parts, "part")
        trees, depth, seed, weights, width = self.trees, self.depth, self.seed, self.weights, len(self.cols)

        def grow(key, pdf):
            import math

            import numpy as np
            import pandas as pd

            def joined(column):
                return np.frombuffer(b"".join(column), np.int64)

            def bins(codes):
                return ((codes[:, None] >> (BITS * np.arange(width))) & (BINS - 1)).astype(np.uint8)

            have, ask = pdf[pdf["learn"]], np.sort(joined(pdf["code"][~pdf["learn"]]))
            codes, counts = joined(have["code"]), np.stack([joined(have["no"]), joined(have["yes"])])
            order = np.argsort(codes)  # codes differ: rows stand in the same order in every task
            have, counts, score = bins(codes[order]), counts[:, order], bins(ask)
            sums, weight = np.zeros(len(ask), np.int64), []
            for n in range(int(key[0]), trees, parts):
                tree = Tree(have, counts, weights, depth, math.ceil(math.sqrt(width)), np.random.default_rng([seed, n]))
                sums += tree.shares(score)
                weight.append(tree.importances())
            out = [(-1, int(key[0]), None, np.concatenate(weight).tobytes())]
            for i in range(0, len(ask), SCORE_CHUNK):
                part = slice(i, i + SCORE_CHUNK)
                out.append((i // SCORE_CHUNK, int(key[0]), ask[part].tobytes(), sums[part].tobytes()))
            return pd.DataFrame(out, columns=["chunk", "part", "codes", "sums"])

        return dealt.groupBy("part").applyInPandas(grow, GROWN)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the probability of class 1: the mean share of the leaves, in column ``out``."""
        spark = SparkSession.getActiveSession()
        coded = df.withColumn("_code", _code(self.thresholds, [F.col(c) for c in self.cols]))
        asked = coded.select(F.col("_code").alias("code")).distinct()
        most = float(self.trees * SHARE)

        def add(pdf):
            import numpy as np
            import pandas as pd

            sums = np.sum([np.frombuffer(s, np.int64) for s in pdf["sums"]], axis=0)
            return pd.DataFrame({"_code": np.frombuffer(pdf["codes"].iloc[0], np.int64), out: sums / most})

        path = scratch_path(spark, "scores")
        self._grown(asked).filter("chunk >= 0").groupBy("chunk").applyInPandas(add, f"_code bigint, `{out}` double").write.parquet(path)
        scores = spark.read.parquet(path)
        kept = [c for c in df.columns if c != out]
        return coded.select(*kept, "_code").join(scores, "_code", "left").select(*kept, out)

    def importances(self):
        import numpy as np

        found = self._grown(None).filter("chunk = -1").select("part", "sums").collect()  # trees x features numbers
        parts, each = len(found), np.zeros((self.trees, len(self.cols)))
        for r in found:
            each[r["part"] :: parts] = np.frombuffer(r["sums"], np.float64).reshape(-1, len(self.cols))
        total = each.sum(0)
        return total / total.sum() if total.sum() else total


def grown(df: DataFrame, cols: list[str], label: str, trees: int, depth: int, seed: int, weight: str | None) -> Grown | None:
    """A forest of all rows of ``df``; None where labels are not 0 and 1, weights differ within a class, or there are many features."""
    if len(cols) > MAX_FEATURES or not trees:
        return None
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    classes = df.groupBy(F.col(label).cast("double").alias("y")).agg(F.min(w).alias("low"), F.max(w).alias("high")).limit(3).collect()
    if not classes or any(r["y"] not in (0.0, 1.0) or r["low"] is None or r["low"] != r["high"] for r in classes):
        return None
    weights = [max([r["low"] for r in classes if r["y"] == y], default=1.0) for y in (0.0, 1.0)]
    thresholds = cuts(df, cols)
    path = scratch_path(df.sparkSession, "binned")
    coded = df.select(_code(thresholds, [F.col(c) for c in cols]).alias("code"), F.col(label).cast("double").alias("y"))
    n = [F.count(F.when(F.col("y") == y, 1)).alias(name) for y, name in ((0.0, "no"), (1.0, "yes"))]
    coded.groupBy("code").agg(*n).write.parquet(path)
    return Grown(path, thresholds, list(cols), weights, trees, depth, seed)
