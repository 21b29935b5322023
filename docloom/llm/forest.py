"""Problem 4: deduplicating new batches against all history, with a prefix-tree hash forest.

Each accepted item stands in ``TREES`` trees, in each under a packed signature of ``PER_TREE`` MinHash values taken in
that tree's own permutation. The trees are kept as runs sorted by (tree, signature) in a shared folder, with a manifest that
a later session takes up. Items that share the first values of a signature stand in one range of a tree. A run is cut into
shelves, ranges of its sorted order of about as many rows each, and a batch reads of it only the shelves that the ranges of
its own signatures fall in. Prefixes start at the full signature and are widened, a value at a time, until the chance to meet an
item of the threshold likeness reaches the recall target. Meetings are verified exactly, decided in order of item_id, and
the accepted items are appended as a new run; runs of like size are merged. History is never hashed again.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import candidates as C
from docloom.llm import shingles
from docloom.llm.lookalike import mapped
from docloom.runtime import drop_path, names_in, read_text, scratch_path, spread, write_text, written

TREES, PER_TREE, BITS = 32, 5, 12
LIKENESS, LEAST_CHARS, RECALL = 0.6, 120, 0.9995
#: A cell is the range of a tree's signatures that share the first so many bits.
CELL_BITS = 20
#: Rows of a shelf, sorted in one task and read as a whole, and the most signatures that shelves are looked up for; a batch of
#: more is taken to fall into all of them.
SHELF_ROWS, MOST_LOOKED_UP = 1_000_000, 262_144
#: Runs that are searched before some are merged.
MOST_RUNS = 4
#: Up to so many signatures of a batch (of 48 bytes) are broadcast to the history; beyond, both are shuffled by prefix.
BROADCAST_POSTINGS = 250_000
_KEPT = ["id", "text_hash", "size", "s0", "s1", "s2", "s3", "text"]
_KEPT_SCHEMA = "id long, text_hash long, size int, s0 long, s1 long, s2 long, s3 long, text string"
_INDEX = "cell int, signature long, id long, size int, s0 long, s1 long"


def recall(likeness: float, depth: int, trees: int = TREES) -> float:
    """The chance that sets of this likeness share a prefix of ``depth`` values in some tree and pass both sketches."""
    return (1 - (1 - likeness**depth) ** trees) * (1 - 2 * C.SKETCH_LOSS)


def depth_for(likeness: float, target: float, trees: int = TREES, per: int = PER_TREE) -> int:
    """Widen the prefix, a value at a time, until the recall target is reached."""
    depth = per
    while depth > 1 and recall(likeness, depth, trees) < target:
        depth -= 1
    return depth


def postings_of(signed: DataFrame) -> DataFrame:
    """The rows of the trees (cell, signature, id, size, s0, s1) of signed items."""
    trees = signed.select(F.posexplode("keys").alias("tree", "signature"), "id", "size", "s0", "s1")
    cell = F.shiftleft("tree", CELL_BITS).bitwiseOR(F.shiftright("signature", BITS * PER_TREE - CELL_BITS).cast("int"))
    return trees.select(cell.alias("cell"), "signature", "id", "size", "s0", "s1")


def shelf(shelves: int) -> Column:
    """The shelf of a row of a run cut into so many; signatures are even, so stretches of cells are."""
    return F.floor(F.col("cell").cast("long") * shelves / (TREES << CELL_BITS)).cast("int")


class HashForest:
    """The accepted items of all earlier batches and their trees, in a folder that all executors share.

    A forest at a path where one was kept before takes up its runs.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least: float = LIKENESS, least_chars: int = LEAST_CHARS, target: float = RECALL):
        self.spark, self.least, self.least_chars, self.target = spark, least, least_chars, target
        self.path = path or scratch_path(spark, "forest")
        self.state: dict = {"runs": [], "made": 0, "last": None, "form": [TREES, PER_TREE, BITS, least, least_chars]}
        if kept := [n for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]:
            self.state = json.loads(read_text(spark, f"{self.path}/{kept[-1]}"))
            if self.state["form"] != [TREES, PER_TREE, BITS, least, least_chars]:
                raise ValueError(f"the forest at {self.path} was made with other parameters")

    @property
    def runs(self) -> list[str]:
        return [r["name"] for r in self.state["runs"]]

    def _read(self, what: str, schema: str, runs: list[str] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for run in self.runs if runs is None else runs:
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.path}/{run}/{what}").select(*out.columns))  # without the shelf
        return out

    def _write_run(self, kept: DataFrame, trees: DataFrame, rows: int) -> dict:
        """A new run; it counts once the manifest names it, so one that an earlier attempt left is written over."""
        run = {"name": f"run-{self.state['made']:08d}", "rows": rows, "shelves": max(1, math.ceil(rows * TREES / SHELF_ROWS))}
        index = trees.withColumn("shelf", shelf(run["shelves"])).repartition(run["shelves"], "shelf").sortWithinPartitions("shelf", "cell", "signature")
        with ThreadPoolExecutor(2) as pool:  # two jobs at a time
            parts = [pool.submit(kept.write.mode("overwrite").parquet, f"{self.path}/{run['name']}/kept")]
            parts.append(pool.submit(index.write.mode("overwrite").partitionBy("shelf").parquet, f"{self.path}/{run['name']}/index"))
            for p in parts:
                p.result()
        return run

    def _commit(self, runs: list[dict], last: int) -> None:
        """Name the runs that count in a new manifest; what no manifest names any more is deleted."""
        gone, before = set(self.runs) - {r["name"] for r in runs}, self.state["made"]
        self.state = self.state | {"runs": runs, "made": before + 1, "last": last}
        write_text(self.spark, f"{self.path}/manifest-{self.state['made']:08d}.json", json.dumps(self.state))
        for old in [f"manifest-{before:08d}.json", *gone]:
            drop_path(self.spark, f"{self.path}/{old}")

    def _append(self, kept: DataFrame, trees: DataFrame, rows: int, last: int) -> None:
        """Append a run. When there are over MOST_RUNS, the newest are merged into the one before while they hold over half as many rows."""
        if not rows:
            return self._commit(self.state["runs"], last)
        runs = [*self.state["runs"], self._write_run(kept, trees, rows)]
        self._commit(runs, last)
        at, total = len(runs) - 1, rows
        while len(runs) > MOST_RUNS and at > 0 and 2 * total > runs[at - 1]["rows"]:
            at, total = at - 1, total + runs[at - 1]["rows"]
        if at < len(runs) - 1:
            old = [r["name"] for r in runs[at:]]
            self._commit([*runs[:at], self._write_run(self._read("kept", _KEPT_SCHEMA, old), self._read("index", _INDEX, old), total)], last)

    def _postings(self, trees: DataFrame, depth: int) -> DataFrame:
        """(key, id, size, s0, s1): one key for the range of signatures that share the first ``depth`` values in a tree."""
        prefix = F.shiftrightunsigned("signature", BITS * (PER_TREE - depth))
        tree = F.shiftright("cell", CELL_BITS).cast("long")
        return trees.select(F.shiftleft(tree, 57).bitwiseXOR(prefix).alias("key"), "id", "size", "s0", "s1")

    def near(self, trees: DataFrame, items: int, depth: int = PER_TREE) -> DataFrame:
        """The rows of the runs' shelves that a batch's signatures fall in; all that share ``depth`` values with one are among them."""
        whole = items * TREES > MOST_LOOKED_UP or BITS * depth < CELL_BITS
        found = self.spark.createDataFrame([], _INDEX)
        for run in self.state["runs"]:
            rows = self.spark.read.schema(f"{_INDEX}, shelf int").parquet(f"{self.path}/{run['name']}/index")
            if run["shelves"] > 1 and not whole:
                asked = [r["shelf"] for r in trees.select(shelf(run["shelves"]).alias("shelf")).distinct().collect()]  # at most a run's shelves
                rows = rows.where(F.col("shelf").isin(asked))
            found = found.union(rows.drop("shelf"))
        return found

    def ingest(self, items: DataFrame, key: str = "item_id", text: str = "content") -> DataFrame:
        """(kept_id, item_id) of the refused items of a batch; the accepted ones join the history.

        Items are taken by id, which must be above all ids of earlier batches; an id that occurs twice is taken once, with
        the text of the least hash. Null and short texts and texts without a run of five characters are neither compared
        nor refused. Null ids are left out.
        """
        rows = spread(items.where(F.length(text) >= self.least_chars).where(F.col(key).isNotNull())).select(F.col(key).cast("long").alias("id"), mapped(F.col(text)).alias("text"))
        batch = written(rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id()), "batch")
        count, low, high = batch.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
        if not count:
            return self.spark.createDataFrame([], "kept_id long, item_id long")
        if self.state["last"] is not None and low <= self.state["last"]:
            raise ValueError(f"item {low} isn't above those of earlier batches")
        # equal texts share one decision, that of the first: its leader
        one = batch.groupBy("id").agg(F.min(F.struct("h", "n")).alias("x")).select("id", "x.h", "x.n")
        tops = one.groupBy("h").agg(F.min(F.struct("id", "n")).alias("t")).select("h", F.col("t.id").alias("leader"), F.col("t.n").alias("top"))
        copies = written(one.join(tops, "h").select("id", "leader", "n", "top"), "copies")
        chosen = batch.select("id", "n", "text").join(C.checked(copies.where("n = top").select("n")), "n", "left_semi").select("id", "text")
        lead = written(chosen.mapInArrow(shingles.signature_batches(TREES, PER_TREE, BITS, with_text=True), shingles.SIGNATURE + ", text string"), "batch-signatures")
        trees = postings_of(lead)
        links = written(self._links(lead, trees, count), "batch-links")
        refused = written(self._decide(links, low), "batch-refused")
        out = self._with_copies(copies, lead, refused)
        gone = C.checked(refused.select("id"))
        self._append(lead.join(gone, "id", "left_anti").select(*_KEPT), trees.join(gone, "id", "left_anti"), lead.count() - refused.count(), high)
        return out

    def _links(self, lead: DataFrame, trees: DataFrame, count: int) -> DataFrame:
        """(a, b), a < b: the leaders of a batch and the earlier items, of the batch or of history, that they resemble."""
        depth = depth_for(self.least, self.target)
        new = self._postings(trees, depth)
        pairs, sketches = C.candidate_pairs(new, new, self.least, same=True), ["id", "s0", "s1", "s2", "s3"]
        known, texts = lead.select(*sketches), lead.select("id", "text")
        if self.runs:
            old = self._postings(self.near(trees, count, depth), depth)
            asked = F.broadcast(new) if count * TREES <= BROADCAST_POSTINGS else new
            pairs = pairs.union(C.candidate_pairs(old, asked, self.least, same=False))
            history = self._read("kept", _KEPT_SCHEMA)
            known, texts = history.select(*sketches).union(known), history.select("id", "text").union(texts)
        likely = C.likely_pairs(pairs, known, lead.select(*sketches), self.least)
        return C.verified(likely, texts, lead.select("id", "text"), self.least).select("a", "b")

    def _decide(self, links: DataFrame, low: int) -> DataFrame:
        """(id, kept): the refused among the linked; an item is decided once all earlier items it resembles are. Ids below
        ``low`` are history, which is accepted."""
        ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
        by_history = links.where(F.col("a") < low).select(F.col("b").alias("id")).distinct().withColumn("known", F.lit(2))
        state = ends.join(by_history, "id", "left").select("id", F.when(F.col("id") < low, 1).otherwise(F.coalesce("known", F.lit(0))).alias("state"))
        inner = links.where(F.col("a") >= low)
        while True:  # 0 open, 1 accepted, 2 refused
            seen = inner.join(state.select(F.col("id").alias("a"), F.col("state").alias("sa")), "a")
            seen = seen.groupBy(F.col("b").alias("id")).agg(F.max(F.col("sa") == 1).alias("hit"), F.max(F.col("sa") == 0).alias("wait"))
            now = F.when(F.col("state") != 0, F.col("state")).when(F.col("hit"), 2).when(F.col("wait"), 0).otherwise(1)
            state = written(state.join(seen, "id", "left").select("id", now.cast("int").alias("state")), "state")
            if state.where("state = 0").isEmpty():
                break
        kept = links.join(state.where("state = 1").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("kept"))
        return state.where("state = 2").select("id").join(kept, "id")

    def _with_copies(self, copies: DataFrame, lead: DataFrame, refused: DataFrame) -> DataFrame:
        """A later copy is refused for its accepted leader, or for what its leader was refused for."""
        compared = lead.select(F.col("id").alias("leader"))  # without those that have no run
        every = copies.select("id", "leader").join(compared, "leader").join(refused.select(F.col("id").alias("leader"), "kept"), "leader", "left")
        return every.where("kept IS NOT NULL OR id <> leader").select(F.coalesce("kept", "leader").alias("kept_id"), F.col("id").alias("item_id"))


def dedup_batches(df: DataFrame, batch: str = "batch_no", per_ingest: int = 12, key: str = "item_id", text: str = "content") -> DataFrame:
    """(kept_id, item_id) of the refused items of all batches; the first batch is a load of its own, the later ones come
    ``per_ingest`` at a time (batches that wait together are taken together, which changes no decision). A null batch
    number counts as the first batch's.
    """
    spark = df.sparkSession
    forest = HashForest(spark)
    lo, hi = df.agg(F.min(batch), F.max(batch)).first()
    out = [spark.createDataFrame([], "kept_id long, item_id long")]
    if lo is None:
        lo = hi = 0
    n = F.coalesce(F.col(batch), F.lit(lo))
    at = lo
    while at <= hi:
        to = at if at == lo else min(hi, at + per_ingest - 1)
        out.append(written(forest.ingest(df.where(n.between(at, to)), key, text), "refused"))
        at = to + 1
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found
