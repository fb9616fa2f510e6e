"""Vector-based refinement of link suggestions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.links import _targets, confidence, indexable
from siteloom.operators.skew import bucketed_rank, top_per_key
from siteloom.session import stage

MIN_SIMILARITY = 48
#: Width of a shell round a pivot in radians, and how many there can be.
SHELL, SHELLS = 0.3, 11


def finite_vector(v: Column) -> Column:
    """Vector as doubles without values that are not finite."""
    return F.filter(v.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when empty, of unequal length or of zero norm."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(0.0)


def page_document(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Text that describes a page to the embedding service; whole, unless the service sets a limit of characters."""
    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit("none")))
    text = F.concat_ws(" | ", part("title", F.col("title")), part("headings", F.array_join("h1s", " | ")),
                       part("description", F.col("description")),
                       F.concat(F.lit("path: "), U.decoded_path(F.col("url"))))
    return pages.withColumn("document", text if limit is None else F.substring(text, 1, limit))


def _unit(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows of length one (zero vectors stay zero), padded to ``dim``."""
    rows = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        rows[i, :len(v)] = v
    size = np.linalg.norm(rows, axis=1)
    return np.divide(rows, size[:, None], out=np.zeros_like(rows), where=size[:, None] > 0)


def _best_sources(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Cosines of one block of weak targets with one block of sources; the best three sources of each target."""
    targets = pdf[pdf["is_target"]]
    sources = pdf[~pdf["is_target"]].sort_values("seq", ignore_index=True)
    out: list[tuple] = []
    if len(targets) and len(sources):
        dim = max(max(map(len, targets["vector"])), max(map(len, sources["vector"])))
        cosine = _unit(targets["vector"], dim) @ _unit(sources["vector"], dim).T
        cosine[targets["vector"].map(len).to_numpy()[:, None] != sources["vector"].map(len).to_numpy()] = 0
        score = np.floor(np.maximum(cosine, 0) * 100 + 0.5).astype(int)
        seqs, wanted = sources["seq"].to_numpy(), targets["seq"].to_numpy()
        # what is closed to a target: pages of its own normal URL and those that link already
        names = pd.factorize(pd.concat([sources["norm"], targets["norm"]]))[0]
        score[names[len(sources):, None] == names[:len(sources)]] = -1
        places = sources.groupby("norm", sort=False).indices
        for row, taken in enumerate(targets["taken"]):
            for norm in taken:
                score[row, places.get(norm, [])] = -1
        rows = np.arange(len(targets))
        for _ in range(3):  # the first of the highest scores is that of the least seq
            best = score.argmax(axis=1)
            top = score[rows, best]
            out += [(key[0], wanted[i], seqs[best[i]], int(top[i])) for i in np.flatnonzero(top >= MIN_SIMILARITY)]
            score[rows, best] = -1
    return pd.DataFrame(out, columns=["audit_id", "target_id", "source_id", "semantic"])


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _nearest_pivot(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The nearest pivot of each page of a block and the angle to it; a vector of length zero is near any."""
    pages, pivots = pdf[~pdf["is_pivot"]], pdf[pdf["is_pivot"]].sort_values("seq")
    dim = max(map(len, pdf["vector"]))
    rows = _unit(pages["vector"], dim)
    angle = _angles(rows, _unit(pivots["vector"], dim))
    best = angle.argmin(axis=1) if len(pages) else np.zeros(0, int)
    far = np.where(rows.any(axis=1), angle[np.arange(len(pages)), best], 0.0) if len(pages) else np.zeros(0)
    return pd.DataFrame({"audit_id": key[0], "seq": pages["seq"], "cell": pivots["seq"].to_numpy()[best], "angle": far})


def _pivot_angles(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The angle between each pivot of a block and every pivot of the audit."""
    own, every = pdf[~pdf["is_pivot"]], pdf[pdf["is_pivot"]]
    dim = max(map(len, pdf["vector"]))
    angle = _angles(_unit(own["vector"], dim), _unit(every["vector"], dim))
    return pd.DataFrame({"audit_id": key[0], "a": np.repeat(own["seq"].to_numpy(), len(every)), "b": np.tile(every["seq"].to_numpy(), len(own)),
                         "angle": angle.ravel()})


def vector_blocks(embedded: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(audit_id, seq, cell, part, angle) of every page, and the angles between the pivots of each audit (audit_id, a, b, angle).

    An audit of n pages gets about n / ``block`` pivots, pages chosen by hash; a page belongs to the cell of the nearest one; the
    shells of a cell are cut by hash into parts of about ``block``. Pages travel once for this, pivots once a block.
    """
    c = F.col
    sizes = embedded.groupBy("audit_id").agg(F.count("*").alias("n"), F.min("seq").alias("least"))
    dealt = embedded.select("audit_id", "seq", "vector").join(sizes, "audit_id").withColumn("blocks", F.ceil(c("n") / block).cast("int"))
    chosen = (F.pmod(F.xxhash64("seq", F.lit(11)), F.ceil(c("n") / c("blocks"))) == 0) | (c("seq") == c("least"))
    pivots = stage(dealt.filter(F.when(c("blocks") > 1, chosen).otherwise(c("seq") == c("least"))).select("audit_id", "seq", "vector", "blocks"))
    everywhere = pivots.select("audit_id", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("i"), "seq", "vector", F.lit(True).alias("is_pivot"))
    own = dealt.select("audit_id", F.pmod(F.xxhash64("seq"), c("blocks")).cast("int").alias("i"), "seq", "vector", F.lit(False).alias("is_pivot"))
    kind = embedded.schema["audit_id"].dataType.simpleString()
    near = stage(own.unionByName(everywhere).groupBy("audit_id", "i").applyInPandas(_nearest_pivot, f"audit_id {kind}, seq long, cell long, angle double"))
    # pages far from their pivot form shells of their own, so that a few of them widen no other block
    near = near.withColumn("shell", F.floor(c("angle") / SHELL).cast("int"))
    counts = near.groupBy("audit_id", "cell", "shell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cells = near.join(counts, ["audit_id", "cell", "shell"]).withColumn(
        "part", (c("shell") + SHELLS * F.pmod(F.xxhash64("seq", F.lit(5)), c("parts"))).cast("int")).drop("parts", "shell")
    few = pivots.withColumn("i", F.pmod(F.xxhash64("seq"), F.ceil(c("blocks") / block)).cast("int"))
    groups = few.select("audit_id", F.explode(F.sequence(F.lit(0), F.ceil(c("blocks") / block).cast("int") - 1)).alias("i"), "seq", "vector", F.lit(True).alias("is_pivot"))
    between = few.select("audit_id", "i", "seq", "vector", F.lit(False).alias("is_pivot")).unionByName(groups).groupBy("audit_id", "i").applyInPandas(
        _pivot_angles, f"audit_id {kind}, a long, b long, angle double")
    return stage(cells), stage(between)


def block_pairs(cells: DataFrame, between: DataFrame, weak: DataFrame) -> DataFrame:
    """Blocks of weak targets with the blocks of sources that may hold a cosine of 0.475: audit_id, target, source (cell, part).

    By the triangle inequality two pages stand at an angle of at least that of their pivots less both distances to these, and of
    one's distance less the pivots' angle and the other's distance; what is then beyond the angle of the least accepted cosine
    is never compared.
    """
    c = F.col
    blocks = cells.groupBy("audit_id", "cell", "part").agg(F.max("angle").alias("far"), F.min("angle").alias("near"))
    aimed = cells.join(weak, ["audit_id", "seq"], "left_semi").groupBy("audit_id", "cell", "part").agg(F.max("angle").alias("far"), F.min("angle").alias("near"))
    left = aimed.select("audit_id", c("cell").alias("a"), c("part").alias("a_part"), c("far").alias("fa"), c("near").alias("na"))
    right = blocks.select("audit_id", c("cell").alias("b"), c("part").alias("b_part"), c("far").alias("fb"), c("near").alias("nb"))
    reach = float(np.arccos((MIN_SIMILARITY - 0.5) / 100)) + 1e-6
    least = F.greatest(c("angle") - c("fa") - c("fb"), c("na") - c("angle") - c("fb"), c("nb") - c("angle") - c("fa"))
    near = left.join(between, ["audit_id", "a"]).join(right, ["audit_id", "b"]).filter(least <= reach)
    return near.select("audit_id", F.struct(c("a").alias("cell"), c("a_part").alias("part")).alias("i"),
                       F.struct(c("b").alias("cell"), c("b_part").alias("part")).alias("j"))


def semantic_links(suggestions: DataFrame, skipped: DataFrame, pages: DataFrame, roots: DataFrame, links: DataFrame,
                   vectors: DataFrame, budget: int | None = None, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(suggestions, skipped targets) after blending in the page vectors.

    All indexable pages with a vector take part. New pairs come from block by block products of about ``block`` targets and
    sources near each other (``block_pairs``); each returns three sources a target, and the best of all blocks stay. ``budget`` cuts
    an audit's list, if given.
    ``vectors``: audit_id, seq, vector. Audits with fewer than two embedded pages keep the base result.
    """
    c = F.col
    live = indexable(pages).select("audit_id", "seq", "url", "word_count", "incoming_links",
                                   U.normalize_link_url(c("url")).alias("norm"), "anchor_text")
    embedded = live.join(vectors.select("audit_id", "seq", finite_vector(c("vector")).alias("vector")),
                          ["audit_id", "seq"]).filter(F.size("vector") > 0)
    enough = embedded.groupBy("audit_id").agg(F.count("*").alias("n")).filter("n >= 2").select("audit_id")
    embedded = stage(embedded.join(enough, "audit_id", "left_semi"))
    suggestions, roots = stage(suggestions), stage(roots.select("audit_id", "root_url"))

    # suggestions whose two pages have vectors: blended score
    side = embedded.select("audit_id", "seq", "vector")
    both = (suggestions.join(side.select("audit_id", c("seq").alias("source_id"), c("vector").alias("v_source")),
                             ["audit_id", "source_id"], "left")
            .join(side.select("audit_id", c("seq").alias("target_id"), c("vector").alias("v_target")),
                  ["audit_id", "target_id"], "left"))
    known = c("v_source").isNotNull() & c("v_target").isNotNull()
    semantic = F.when(known, X.js_round(F.greatest(F.lit(0.0), cosine_similarity(c("v_source"), c("v_target"))) * 100))
    blended = F.least(F.lit(100), X.js_round(c("score") * 0.58 + c("semantic") * 0.42))
    enhanced = (both.withColumn("semantic", semantic)
                .withColumn("new_score", F.when(c("semantic").isNull(), c("score")).otherwise(blended))
                .withColumn("confidence", F.when(c("semantic").isNull(), c("confidence")).otherwise(
                    confidence(c("new_score"), 75, 52)))
                .withColumn("reasons", F.when(c("semantic").isNull(), c("reasons")).otherwise(F.array_append(
                    c("reasons"), F.concat(F.lit("Semantic similarity: "), c("semantic").cast("string"), F.lit("/100.")))))
                .withColumn("score", c("new_score")).withColumn("added", F.lit(0)))

    # new pairs for weak targets, a bounded matrix at a time
    weak = _targets(embedded, roots).filter("incoming_links <= 1").select("audit_id", "seq").withColumn("weak", F.lit(True))
    have = (links.select("audit_id", U.normalize_link_url(c("src")).alias("s"), U.normalize_link_url(c("dst")).alias("t"))
            .unionByName(suggestions.select("audit_id", U.normalize_link_url(c("source_url")).alias("s"),
                                            U.normalize_link_url(c("target_url")).alias("t"))))
    # weak targets have one incoming link at most, so what is taken is a short list
    held = (have.join(embedded.join(weak, ["audit_id", "seq"]).select("audit_id", c("norm").alias("t")).distinct(), ["audit_id", "t"], "left_semi")
            .groupBy("audit_id", c("t").alias("norm")).agg(F.collect_set("s").alias("taken")))
    schema = T.StructType([pages.schema["audit_id"], T.StructField("target_id", T.LongType()),
                           T.StructField("source_id", T.LongType()), T.StructField("semantic", T.IntegerType())])
    cells, between = vector_blocks(embedded, block)
    pairs = stage(block_pairs(cells, between, weak))
    none = F.array().cast("array<string>")
    dealt = embedded.join(cells.select("audit_id", "seq", F.struct("cell", "part").alias("at")), ["audit_id", "seq"])
    sources = dealt.withColumnRenamed("at", "j").join(pairs, ["audit_id", "j"]).select(
        "audit_id", "i", "j", "seq", "norm", "vector", none.alias("taken"), F.lit(False).alias("is_target"))
    targets = dealt.withColumnRenamed("at", "i").join(weak, ["audit_id", "seq"]).join(pairs, ["audit_id", "i"]).join(
        held, ["audit_id", "norm"], "left").select(
        "audit_id", "i", "j", "seq", "norm", "vector", F.coalesce("taken", none).alias("taken"), F.lit(True).alias("is_target"))
    near = sources.unionByName(targets).groupBy("audit_id", "i", "j").applyInPandas(_best_sources, schema)
    ranked = top_per_key(near, ["audit_id", "target_id"], [F.desc("semantic"), "source_id"], 3, "rank")
    links_in = embedded.select("audit_id", c("seq").alias("target_id"), "incoming_links")
    new = ranked.join(links_in, ["audit_id", "target_id"]).filter((c("rank") <= 2) | (c("incoming_links") == 0)).drop("rank", "incoming_links")
    info = embedded.select("audit_id", "seq", "url", "word_count", "anchor_text")
    named = (new.join(info.select("audit_id", c("seq").alias("source_id"), c("url").alias("source_url"),
                                  c("word_count").alias("words")), ["audit_id", "source_id"])
             .join(info.select("audit_id", c("seq").alias("target_id"), c("url").alias("target_url"), "anchor_text"),
                   ["audit_id", "target_id"]))
    deep = c("words") >= 150
    score = F.least(F.lit(100), X.js_round(c("semantic") * 0.88 + F.when(deep, 8).otherwise(0)))
    additions = named.withColumn("score", score).withColumn("confidence", confidence(c("score"), 75, 52)).withColumn(
        "reasons", F.filter(F.array(
            F.concat(F.lit("Semantic similarity: "), c("semantic").cast("string"), F.lit("/100.")),
            F.lit("The source does not already link to the target."),
            F.when(deep, "Source page has enough context for an editorial link.")), lambda r: r.isNotNull())).withColumn(
        "status", F.lit("proposed")).withColumn("added", F.lit(1))
    cols = ["audit_id", "source_id", "target_id", "source_url", "target_url", "anchor_text", "score", "confidence",
            "reasons", "status", "added"]
    # counted in blocks of equal score, so that a large audit is not one task
    every = enhanced.select(*cols).unionByName(additions.select(*cols))
    merged = bucketed_rank(every, ["audit_id"], -c("score"), [F.desc("score"), "source_url", "added", "target_id"], "position")
    if budget is not None:
        merged = merged.filter(c("position") <= budget)
    # without a budget every pair stays, so what is skipped needs neither scores nor positions
    matched = (every if budget is None else merged).select("audit_id", U.normalize_link_url(c("target_url")).alias("norm")).distinct()
    left = (skipped.withColumn("norm", U.normalize_link_url(c("target_url")))
            .join(matched, ["audit_id", "norm"], "left_anti").drop("norm"))
    return merged, left
