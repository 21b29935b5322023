"""Problem 7: mixing sources to target shares of the total size, by entropy balancing.

Each mix takes as many tokens in all as its shares allow: the largest total of which no source has to give more than
``max_repeats`` times its tokens. Document rates w = exp(b x), x the size over the source's mean size, are the
solution nearest to taking every document once (in relative entropy) that meets the sum of tokens per source. The dual
is solved by Newton steps inside a bracket; each round sums over the table of distinct sizes in the cluster, at several points
at once, and returns a few numbers per source of a mix. Rates are capped at max_repeats and rounded to copies by systematic sampling over documents ordered by size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.tokens import VOCABULARY, sized
from docloom.runtime import written

#: Rounds of the solver and the gap (in documents of mean size, over all documents) at which a rate is settled.
STEPS, CLOSE = 30, 1e-9
#: Rows of a lot of the rounding, lots numbered together, and starting points that it tries.
LOT_ROWS, STRETCH, OFFSETS = 50_000, 1024, 32
#: Points of the dual that a round looks at: the first one over the whole line, later ones close around Newton's estimates.
_FIRST = [0.0, *[s * 10.0**e for e in (-3, -2, -1, 0, 1, 2, 3) for s in (-3.0, -1.0, 1.0, 3.0)]]
_WIDEST = 1e9
_NEAR = [0.0, *[s * 10.0**-e for e in (2, 4, 6, 9) for s in (-1.0, 1.0)]]


def source_name(c):
    """A source under one spelling: trimmed, lower case, blanks and hyphens as underscores; blank names are null."""
    x = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}\-]+", "_")
    return F.when(x != "", x)


def _sums(sizes: DataFrame, live: list[dict], points: list[list[float]]) -> list[dict[int, tuple[float, float]]]:
    """Per (mix, source), the sum of w x and of its slope at each of its points; one pass over the table of sizes."""
    rows = [(i, k, t["source"], t["mean"], float(t["max_repeats"]), t["most"], b) for i, t in enumerate(live) for k, b in enumerate(points[i])]
    now = sizes.sparkSession.createDataFrame(rows, "i int, k int, source string, mean double, cap double, most double, b double")
    x = F.col("n_tokens") / F.col("mean")
    raw = F.exp(F.least(F.col("b") * x, F.lit(50.0)))
    w, free = F.least(raw, F.col("cap")), (raw < F.col("cap")).cast("double")
    n = F.col("n")
    got = (
        sizes.join(F.broadcast(now), "source").where("n_tokens <= most").withColumn("x", x).withColumn("w", w).withColumn("free", free).groupBy("i", "k")
        .agg(F.sum(n * F.col("w") * F.col("x")).alias("s"), F.sum(n * F.col("w") * F.col("free") * F.col("x") * F.col("x")).alias("h"))
    )
    out: list[dict[int, tuple[float, float]]] = [{} for _ in live]
    for r in got.collect():  # a few numbers per source of a mix
        out[r["i"]][r["k"]] = r["s"], r["h"]
    return out


def _step(t: dict, points: list[float], got: dict[int, tuple[float, float]]) -> list[float]:
    """Take the sums of a round into a target's bracket; the points of its next round, none once it is settled."""
    gaps = {b: (t["docs"] * t["rate"] - got[k][0], got[k][1]) for k, b in enumerate(points)}
    t["b"] = min(gaps, key=lambda b: abs(gaps[b][0]))
    if abs(gaps[t["b"]][0]) <= CLOSE * max(1.0, t["docs"]):
        t["done"] = True
        return []
    low = t["low"] = max([t["low"], *[b for b, (gap, _) in gaps.items() if gap > 0]])
    high = t["high"] = min([t["high"], *[b for b, (gap, _) in gaps.items() if gap < 0]])
    near = {(low + high) / 2, *([math.copysign(math.sqrt(low * high), low)] if low * high > 0 else [])}
    for b in (low, high):
        if b in gaps and gaps[b][1] > 1e-12:
            near |= {b + gaps[b][0] / gaps[b][1] + (high - low) * e for e in _NEAR}
    inside = sorted(b for b in near if low < b < high)
    t["done"] = not inside  # the bracket's ends are neighbouring numbers
    return inside


def _newton(sizes: DataFrame, wanted: list[dict]) -> list[dict]:
    """The dual variable b of each wanted (mix, source), and ``done``: whether it settled.

    The sum of w x rises with b. A round evaluates it at several points in one distributed pass, keeps the bracket between
    the nearest points on either side, and puts the next points around the Newton steps from its two ends.
    """
    live = [w | {"b": 0.0, "low": -_WIDEST, "high": _WIDEST, "done": w["rate"] >= w["max_repeats"] * (1 - 1e-9)} for w in wanted]
    points = [[] if t["done"] else _FIRST for t in live]
    for _ in range(STEPS):
        if not any(points):
            break
        points = [_step(t, own, got) if own else [] for t, own, got in zip(live, points, _sums(sizes, live, points))]
    return live


class Mixing:
    """The mixes of a target table (mix_id, source, target_share, max_repeats), a short table, over a table of documents."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY):
        self.spark = docs.sparkSession
        named = docs.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).where("source IS NOT NULL")
        self.key = key
        sizes = sized(named, ["key", "source"], "text", vocabulary).where("n_tokens > 0")
        # a number of each row, written with it, deals rows to lots even where one key repeats
        self.sizes = written(sizes.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "sized")
        self.targets = [
            r.asDict() for r in targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").orderBy("mix_id", "source").collect()
        ]
        self.counts = written(self.sizes.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")
        self.plans = _newton(self.counts, self._plans())

    def _plans(self) -> list[dict]:
        """What each source of a mix has to give: documents, mean size, wanted tokens and rate.

        A document larger than all its source has to give a mix can't be taken even once; the totals are then taken again
        without it, until every document that counts fits. ``left_out`` says how many don't.
        """
        live = [t | {"most": float("inf")} for t in self.targets if t["target_share"] > 0 and t["max_repeats"] > 0]
        n, fits, every = F.col("n"), F.col("n_tokens") <= F.col("most"), None
        while live:  # each round leaves out at least one size of a source
            limits = self.spark.createDataFrame([(i, t["source"], t["most"]) for i, t in enumerate(live)], "i int, source string, most double")
            rows = self.counts.join(F.broadcast(limits), "source").where(fits).groupBy("i")
            got = {r["i"]: r for r in rows.agg(F.sum(n).alias("docs"), F.sum(n * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("largest")).collect()}
            every = every or {i: r["docs"] for i, r in got.items()}
            plans, settled = [], True
            for mix in dict.fromkeys(t["mix_id"] for t in live):
                own = [(i, t) for i, t in enumerate(live) if t["mix_id"] == mix and i in got]
                share = sum(t["target_share"] for _, t in own)
                total = min((t["max_repeats"] * got[i]["tokens"] * share / t["target_share"] for i, t in own), default=0.0)
                for i, t in own:
                    docs, tokens, want = got[i]["docs"], got[i]["tokens"], total * t["target_share"] / share
                    plans.append(t | {"docs": docs, "mean": tokens / docs, "rate": min(want / tokens, float(t["max_repeats"])), "want": want, "left_out": every[i] - docs})
                    if got[i]["largest"] > want:
                        t["most"], settled = want, False
            if settled:
                return plans
        return []

    def _rates(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(p["mix_id"], p["source"], p["mean"], float(p["max_repeats"]), p["b"], p["rate"] >= p["max_repeats"] * (1 - 1e-9), p["most"]) for p in self.plans],
            "mix_id int, source string, mean double, cap double, b double, whole boolean, most double",
        )

    def selection(self) -> DataFrame:
        """(mix_id, source, <key>, n_tokens, copies) of each document that a mix takes at least once.

        Documents without a source or without tokens are in no mix; rows of one key are documents each; a source named
        by a mix that no document has gives none. A target table without rows gives an empty result.
        """
        rate = F.least(F.exp(F.least(F.col("b") * F.col("n_tokens") / F.col("mean"), F.lit(50.0))), F.col("cap"))
        rows = self.sizes.join(F.broadcast(self._rates()), "source").where("n_tokens <= most").withColumn("w", F.when(F.col("whole"), F.col("cap")).otherwise(rate))
        w = F.round("w", 9)
        rows = rows.select("mix_id", "source", "key", "n_tokens", "salt", F.floor(w).alias("sure"), (w - F.floor(w)).alias("part"))
        # systematic rounding: the running sum of fractional parts, in order of size, steps over a whole number; of
        # several starting points the one is taken that comes nearest to the wanted tokens
        lots = max(1, math.ceil(self.sizes.count() / LOT_ROWS))
        band = F.floor(F.log2(F.col("n_tokens").cast("double")) * 8).cast("int")
        rows = rows.withColumn("band", band).withColumn("lot", F.pmod(F.col("salt"), F.lit(lots)).cast("int"))
        spot = ["mix_id", "source", "band", "lot"]
        sums = written(rows.groupBy(*spot).agg(F.sum("part").alias("s")), "lots").withColumn("stretch", F.floor(F.col("lot") / STRETCH))
        # sums before a lot: of the stretches before its own, and of the lots before it in its stretch
        outer = Window.partitionBy("mix_id", "source").orderBy("band", "stretch").rowsBetween(Window.unboundedPreceding, -1)
        inner = Window.partitionBy("mix_id", "source", "band", "stretch").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
        far = sums.groupBy("mix_id", "source", "band", "stretch").agg(F.sum("s").alias("s")).withColumn("far", F.coalesce(F.sum("s").over(outer), F.lit(0.0))).drop("s")
        sums = sums.withColumn("near", F.coalesce(F.sum("s").over(inner), F.lit(0.0))).join(far, ["mix_id", "source", "band", "stretch"])
        sums = sums.select(*spot, (F.col("far") + F.col("near")).alias("before"))
        inside = Window.partitionBy(*spot).orderBy("n_tokens", "salt").rowsBetween(Window.unboundedPreceding, 0)
        run = rows.join(sums, spot).withColumn("upto", F.col("before") + F.sum("part").over(inside))
        run = written(run.select("mix_id", "source", "key", "n_tokens", "sure", "part", "upto"), "rounding")

        def copies(start):
            return F.col("sure") + F.floor(F.round(F.col("upto") + start, 6)) - F.floor(F.round(F.col("upto") - F.col("part") + start, 6))

        tried = run.groupBy("mix_id", "source").agg(*[F.sum(F.col("n_tokens") * copies(F.lit((k + 0.5) / OFFSETS))).alias(f"t{k}") for k in range(OFFSETS)])
        want = {(p["mix_id"], p["source"]): p["want"] for p in self.plans}
        best = []
        for r in tried.collect():  # one row per source of a mix
            goal = want[r["mix_id"], r["source"]]
            best.append((r["mix_id"], r["source"], (min(range(OFFSETS), key=lambda k: abs(r[f"t{k}"] - goal)) + 0.5) / OFFSETS))
        starts = self.spark.createDataFrame(best, "mix_id int, source string, start double")
        run = run.join(F.broadcast(starts), ["mix_id", "source"])
        out = run.select("mix_id", "source", F.col("key").alias(self.key), "n_tokens", copies(F.col("start")).cast("int").alias("copies"))
        return out.where("copies > 0")

    def shares(self, selection: DataFrame) -> DataFrame:
        """(mix_id, source, target_share, max_repeats, actual_share, tokens, documents, most_copies, settled, left_out) for every row of the target table.

        ``settled``: the source's rate met its tokens; false if the solver stopped before, null for a source without documents.
        ``left_out``: documents larger than all that their source has to give the mix.
        """
        got = selection.groupBy("mix_id", "source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
        )
        said = {(p["mix_id"], p["source"]): (p["done"], p["left_out"]) for p in self.plans}
        want = self.spark.createDataFrame(
            [(t["mix_id"], t["source"], t["target_share"], t["max_repeats"], *said.get((t["mix_id"], t["source"]), (None, 0))) for t in self.targets],
            "mix_id int, source string, target_share double, max_repeats int, settled boolean, left_out long",
        )
        x = want.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
        total = F.sum("tokens").over(Window.partitionBy("mix_id"))
        share = F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(0.0)
        return x.select("mix_id", "source", "target_share", "max_repeats", share.alias("actual_share"), "tokens", "documents", "most_copies", "settled", "left_out")
