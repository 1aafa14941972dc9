"""Pairs for labelling, thresholds from labels, fusion of methods, metrics and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import hash_fraction, next_above, safe_div
from tallyforge.functions.text import containment, jaccard, meaningful_tokens, norm
from tallyforge.operators.graph import components
from tallyforge.schema import q
from tallyforge.storage import Scratch

FALSE_MERGE, FALSE_SPLIT = 5.0, 1.0
# Labels of pairs by whether the products are the same but for their packs, and words for yes and no.
SAME, DIFFERENT = ("exact_duplicate", "same_product_different_pack"), ("different_product",)
YES, NO = ("1", "true", "t", "yes", "y", "same", "same_base_product", "exact_duplicate"), ("0", "false", "f", "no", "n", "different", "different_product")
DIFFERENT_BELOW, DUPLICATE_FROM = 0.55, 0.82


# Candidates


def token_pairs(records: DataFrame, most_in_block: int = 120, least_shared: int = 1) -> DataFrame:
    """(a, b, shared) of records that share a meaningful token: tokens of at most ``most_in_block`` records pair up, so
    a token gives a bounded number of pairs. ``records``: id, title."""
    rows = records.select("id", F.explode(meaningful_tokens(F.col("title"))).alias("token"))
    usual = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most_in_block)).select("token")
    rows = rows.join(usual, "token")
    pairs = rows.join(rows.toDF("token", "other"), "token").where("id < other")
    return pairs.groupBy(F.col("id").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)


def title_pairs(records: DataFrame, most_in_block: int = 80) -> DataFrame:
    """Pairs of records whose titles are equal after normalisation."""
    rows = records.select("id", norm(F.col("title")).alias("key")).where("key <> ''")
    usual = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most_in_block)).select("key")
    rows = rows.join(usual, "key")
    return rows.join(rows.toDF("key", "other"), "key").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))


def char_ratio(a: Column, b: Column) -> Column:
    """The longest-common-blocks ratio of two normalised titles, in an Arrow UDF, once for each distinct pair of a batch."""
    from pyspark.sql.functions import pandas_udf

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        known: dict[tuple, float] = {}
        return pd.Series([known[p] if (p := (u or "", v or "")) in known else known.setdefault(p, SequenceMatcher(None, *p).ratio()) for u, v in zip(x, y, strict=True)], dtype=float)

    from tallyforge.functions.text import title

    return pandas_udf(ratio, "double")(title(a), title(b))


def _similarity(a: Column, b: Column, ratio: Column) -> Column:
    s, t = meaningful_tokens(a), meaningful_tokens(b)
    return F.round(F.greatest(jaccard(s, t), F.lit(0.65) * containment(s, t) + F.lit(0.35) * ratio), 6)


def title_similarity(a: Column, b: Column) -> Column:
    """The larger of the tokens' Jaccard and of a blend of containment and character similarity, to six places."""
    return _similarity(a, b, char_ratio(a, b))


def rule_score(pairs: DataFrame, a: str = "title_a", b: str = "title_b", name: str = "score") -> DataFrame:
    """The score of the matcher by rules: the larger of the character ratio and the title similarity; 0 without titles."""
    from tallyforge.functions.text import title

    rows = pairs.withColumn("_c", char_ratio(F.col(a), F.col(b)))
    some = (F.coalesce(title(F.col(a)), F.lit("")) != "") & (F.coalesce(title(F.col(b)), F.lit("")) != "")
    return rows.withColumn(name, F.when(some, F.round(F.greatest(F.col("_c"), _similarity(F.col(a), F.col(b), F.col("_c"))), 6)).otherwise(F.lit(0.0))).drop("_c")


def lexical_candidates(records: DataFrame, least: float = 0.46, least_shared: int = 1, title_block: int = 80, token_block: int = 120) -> DataFrame:
    """(a, b, shared, similarity) of records that share a title or a meaningful token and are similar enough. Equal titles
    count as ``least_shared`` tokens more. ``dropped_blocks`` tells which titles and tokens were too frequent to pair up."""
    shared = token_pairs(records, token_block).union(title_pairs(records, title_block).withColumn("shared", F.lit(max(1, least_shared)).cast("long")))
    pairs = shared.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= least_shared)
    titles = records.select("id", "title")
    both = pairs.join(titles.toDF("a", "_ta"), "a").join(titles.toDF("b", "_tb"), "b")
    return both.withColumn("similarity", title_similarity(F.col("_ta"), F.col("_tb"))).where(F.col("similarity") >= least).select("a", "b", "shared", "similarity")


def dropped_blocks(records: DataFrame, title_block: int = 80, token_block: int = 120) -> DataFrame:
    """kind, value, records of the titles and tokens that ``lexical_candidates`` passes over."""
    titles = records.select(F.lit("title").alias("kind"), norm(F.col("title")).alias("value")).where("value <> ''")
    tokens = records.select(F.lit("token").alias("kind"), F.explode(meaningful_tokens(F.col("title"))).alias("value"))
    return titles.union(tokens).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") > F.when(F.col("kind") == "title", title_block).otherwise(token_block))


# Sources of candidates in their order, and how many pairs each extra source may add.
SOURCES = ("faiss_embedding_topk", "supplemental_lexical_overlap", "supplemental_same_brand_pack", "supplemental_cross_marketplace_random", "supplemental_random_control")
BUDGETS = dict(zip(SOURCES[1:], (8_000, 6_000, 3_000, 3_000), strict=True))
_SIDES = ("marketplace_a", "sku_a", "marketplace_b", "sku_b")


def ordered_candidates(pairs: DataFrame, most: int | None = None, score: str = "baseline_similarity_score", shared: str = "shared_title_tokens_count") -> DataFrame:
    """Candidates by score, shared tokens and sides; the first ``most`` of them."""
    rows = pairs.orderBy(F.desc(score), F.desc(shared), *_SIDES)
    return rows if most is None else rows.limit(most)


def capped_candidates(pairs: DataFrame, most: int | None, score: str = "embedding_similarity_score", rank: str = "candidate_rank") -> DataFrame:
    """Candidates by source, score, rank and sides. Of more than ``most`` a third at most comes from the extra sources,
    and the rest from the first."""
    source = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("candidate_source")), F.lit(0))
    place = F.when(source == 0, 99).otherwise(source - 1)
    order = [place.asc(), F.desc(score), F.col(rank), *(F.col(c) for c in _SIDES)]
    if most is None:
        return pairs.orderBy(*order)
    first = F.col("candidate_source") == SOURCES[0]
    counts = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~first).alias("more")).first()
    if counts["n"] <= most:
        return pairs.orderBy(*order)
    more = min(counts["more"], most // 3)
    #: Two bounded sorts; neither source is numbered as a whole.
    return pairs.where(first).orderBy(*order).limit(most - more).union(pairs.where(~first).orderBy(*order).limit(more)).orderBy(*order)


def supplemental(records: DataFrame, known: DataFrame, budgets: Mapping[str, int] = BUDGETS, least: float = 0.46, seed: int = 42, buckets: int = 256, reach: int = 3) -> DataFrame:
    """(a, b, candidate_source) of pairs that no earlier source has: similar titles, the most similar first; the same
    brand and pack; different marketplaces; any two. All but the first are neighbours, up to ``reach`` apart, in the
    order of a seeded hash, within a brand or a bucket of the hash, so a source never pairs all with all.

    ``records``: id, title, brand, marketplace, unit_amount, total_amount, multipack_count; ``known``: a, b.
    """
    from tallyforge.operators.identity import same_pack

    scratch = Scratch(records.sparkSession, "supplemental")
    pack = ("unit_amount", "total_amount", "multipack_count")
    rows = records.withColumns({"_o": F.xxhash64("id", F.lit(seed)), "_brand": norm(F.col("brand"))}).withColumn("_bucket", F.pmod("_o", F.lit(buckets)).cast("string"))

    def neighbours(df: DataFrame, within: str) -> DataFrame:
        w = Window.partitionBy(within).orderBy("_o", "id")
        side = F.struct("id", "_brand", "marketplace", *pack)
        sides = df.withColumn("_next", F.array_compact(F.array(*(F.lead(side, k).over(w) for k in range(1, reach + 1)))))
        return sides.withColumn("y", F.explode("_next")).select(side.alias("x"), "y")

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).where("a <> b").distinct()

    brand = neighbours(rows.where("_brand <> ''"), "_brand").where(same_pack(*(F.col(f"{s}.{c}") for c in pack for s in ("x", "y"))))
    every = neighbours(rows, "_bucket")
    sources = {
        SOURCES[1]: lexical_candidates(records, least).withColumn("_k", -F.col("similarity")),
        SOURCES[2]: named(brand).withColumn("_k", F.xxhash64("a", "b", F.lit(seed))),
        SOURCES[3]: named(every.where("not (x.marketplace <=> y.marketplace)")).withColumn("_k", F.xxhash64("a", "b", F.lit(seed + 1))),
        SOURCES[4]: named(every).withColumn("_k", F.xxhash64("a", "b", F.lit(seed + 2))),
    }
    taken, out = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), None
    for name, pairs in sources.items():
        if budgets.get(name, 0) <= 0:
            continue
        new = pairs.join(taken, ["a", "b"], "left_anti").orderBy("_k", "a", "b").limit(budgets[name])
        new = scratch.keep(new.select("a", "b", F.lit(name).alias("candidate_source")), name)
        taken = taken.union(new.select("a", "b"))
        out = new if out is None else out.union(new)
    return out


def pair_flags(pairs: DataFrame) -> DataFrame:
    """cross_marketplace, brand_relation-based hard_negative and pack_variant of pairs with ``_a`` and ``_b`` columns:
    marketplace, brand, same_pack, flavors_a/_b, similarity."""
    same_brand = (norm(F.col("brand_a")) == norm(F.col("brand_b"))) & (norm(F.col("brand_a")) != "")
    fa, fb = F.col("flavors_a"), F.col("flavors_b")
    other_flavor = (F.size(fa) > 0) & (F.size(fb) > 0) & (F.size(F.array_intersect(fa, fb)) == 0)
    return pairs.withColumns(
        {
            "cross_marketplace": norm(F.col("marketplace_a")) != norm(F.col("marketplace_b")),
            "hard_negative": same_brand & F.col("same_pack") & other_flavor,
            "pack_variant": same_brand & ~F.col("same_pack") & ~other_flavor & (F.col("similarity") >= 0.52),
        }
    )


# Sampling


def sampled(pairs: DataFrame, quotas: Mapping[str, int], strata: Mapping[str, Column], brand_cap: int, seed: int = 42, used: DataFrame | None = None) -> DataFrame:
    """A stratified sample: each stratum in turn takes its quota, in the order of a seeded hash, of pairs that no earlier
    one took and at most ``brand_cap`` of a brand; what a stratum lacks is filled from the rest. ``pairs``: pair_key,
    brand. The sample is as small as the quotas; only its keys are joined."""
    order = hash_fraction(F.col("pair_key"), seed)
    taken = used.select("pair_key") if used is not None else pairs.sparkSession.createDataFrame([], "pair_key string")
    out = None
    lacking = 0
    for name, quota in [*quotas.items(), ("backfill", 0)]:
        condition = strata.get(name, F.lit(True))
        want = quota if name != "backfill" else lacking
        if want <= 0:
            continue
        pool = pairs.where(condition).join(taken, "pair_key", "left_anti").withColumn("_o", order)
        per_brand = F.row_number().over(Window.partitionBy("brand").orderBy("_o", "pair_key"))
        chosen = pool.withColumn("_b", per_brand).where(F.col("_b") <= brand_cap).orderBy("_o", "pair_key").limit(want).drop("_o", "_b").withColumn("stratum", F.lit(name))
        chosen = Scratch(pairs.sparkSession, "sample").keep(chosen, name)
        lacking += max(0, want - chosen.count()) if name != "backfill" else 0
        taken = taken.union(chosen.select("pair_key"))
        out = chosen if out is None else out.unionByName(chosen)
    return out


def position_strata(df: DataFrame, score: str, key: str, top: float, bottom: float) -> DataFrame:
    """``position``: top, bottom or middle share by rank of the score, ties by key. Ranks come from sorted ranges."""
    from tallyforge.operators.identity import numbered

    total = df.count()
    rows = numbered(df.withColumn("_s", -F.col(score)), ["_s", key]).drop("_s")
    rank = F.col("_k")
    return rows.withColumn("position", F.when(rank <= int(total * top), "top").when(rank > total - int(total * bottom), "bottom").otherwise("middle")).drop("_k")


def refilled(labels: DataFrame, fresh: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Rows with a label stay; unseen fresh pairs, by a seeded hash, fill up to ``size``."""
    kept = labels.where("label is not null and trim(label) <> ''")
    new = fresh.join(labels.select("pair_key"), "pair_key", "left_anti")
    lack = max(0, size - kept.count())
    return kept.unionByName(new.orderBy(hash_fraction(F.col("pair_key"), seed), "pair_key").limit(lack), allowMissingColumns=True)


def frozen(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of each pair, conflicting pairs). ``rows``: pair_key, label, priority, row. Pairs whose labels differ
    are conflicts and leave; uncertain labels too; of the others the first by priority stays."""
    marked = rows.where("label is not null and label <> 'uncertain'")
    labels = marked.groupBy("pair_key").agg(F.countDistinct("label").alias("n"))
    w = Window.partitionBy("pair_key").orderBy("priority", "row")
    first = marked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.join(labels.where("n = 1").select("pair_key"), "pair_key"), labels.where("n > 1").select("pair_key")


# Calibration


def labelled(df: DataFrame, score: str = "score", label: str = "label", target: str = "same_base_product") -> DataFrame:
    """Rows with a number as score and a target of 0 or 1; the target is its own column, else read from the label."""
    if score not in df.columns or target not in df.columns and label not in df.columns:
        raise ValueError(f"there is no column {score!r}, {target!r} or {label!r}")
    word = F.trim(F.col(target if target in df.columns else label).cast("string"))
    word, yes, no = (F.regexp_replace(F.lower(word), r"^([01])\.0+$", "$1"), YES, NO) if target in df.columns else (word, SAME, DIFFERENT)
    rows = df.withColumns({target: F.when(word.isin(*yes), 1).when(word.isin(*no), 0), "score": F.nanvl(F.col(score).try_cast("double"), F.lit(None).cast("double"))})
    return rows.where(F.col("score").isNotNull() & F.col(target).isNotNull())


def binary_metrics(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy and cost of ``predicted`` against ``target`` (booleans)."""
    one = F.lit(1.0) if weight is None else weight
    total = lambda p, t: F.sum(F.when((F.col("predicted") == p) & (F.col("target") == t), one).otherwise(F.lit(0.0)))
    out = df.groupBy(*by).agg(total(True, True).alias("tp"), total(True, False).alias("fp"), total(False, False).alias("tn"), total(False, True).alias("fn"))
    return with_rates(out)


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns(
        {
            "precision": safe_div(tp, tp + fp, 0.0),
            "recall": safe_div(tp, tp + fn, 0.0),
            "f1": safe_div(2 * tp, 2 * tp + fp + fn, 0.0),
            "accuracy": safe_div(tp + tn, tp + fp + tn + fn, 0.0),
            "cost": FALSE_MERGE * fp + FALSE_SPLIT * fn,
        }
    )


def link_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of predicted links against true ones, with the weights of false and missed links, and how they changed
    from ``baseline`` if that is there. ``df``: target, predicted (booleans), pair_weight (1 where missing)."""
    y, p = F.coalesce("target", F.lit(False)), F.coalesce("predicted", F.lit(False))
    w = F.coalesce(F.col("pair_weight").cast("double"), F.lit(1.0)) if "pair_weight" in df.columns else F.lit(1.0)
    sums = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    sums += [F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)).alias(n) for n, c in (("false_link_weight", ~y & p), ("missed_link_weight", y & ~p))]
    if "baseline" in df.columns:
        b = F.coalesce("baseline", F.lit(False))
        sums += [F.count_if(b != p).alias("changed"), F.avg((b != p).cast("double")).alias("change_rate"), F.count_if(b & ~p).alias("cuts"), F.count_if(~b & p).alias("adds")]
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), safe_div(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    rates = {"precision": precision, "recall": recall}
    scores = {"f1": safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0), "f0_5": safe_div(1.25 * F.col("precision") * F.col("recall"), 0.25 * F.col("precision") + F.col("recall"), 0.0)}
    return df.groupBy(*by).agg(*sums).withColumns(rates).withColumns(scores)


def threshold_grid(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics at each distinct score as a threshold, and just above the largest. One sort of distinct scores and a
    running sum: scores are counted first, so the window sees one row a score."""
    counts = df.groupBy(*by, "score").agg(F.count_if("target").cast("double").alias("p"), F.count_if(~F.col("target")).cast("double").alias("n"))
    above = counts.groupBy(*by).agg(next_above(F.max("score")).alias("score")).select(*by, "score", F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    whole = Window.partitionBy(*by)
    rows = counts.select(*by, "score", "p", "n").unionByName(above)
    rows = rows.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w), "_p": F.sum("p").over(whole), "_n": F.sum("n").over(whole)})
    return with_rates(rows.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})).drop("p", "n", "_p", "_n").withColumnRenamed("score", "threshold")


def best_thresholds(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of each strategy: ``max_f1`` (ties: precision, then the higher threshold) and ``cost_sensitive``
    (least cost; ties: fewer false merges, then the higher threshold)."""
    f1 = F.max_by("threshold", F.struct("f1", "precision", "threshold")).alias("max_f1")
    cost = F.max_by("threshold", F.struct(-F.col("cost"), -F.col("fp"), "threshold")).alias("cost_sensitive")
    one = grid.groupBy(*by).agg(f1, cost)
    return one.select(*by, F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("threshold")) for s in ("max_f1", "cost_sensitive")))).alias("x")).select(*by, "x.*")


def calibrated(df: DataFrame) -> DataFrame:
    """Thresholds by method from the rows of split ``dev``, evaluated on each split. ``df``: method, split, score, target."""
    chosen = best_thresholds(threshold_grid(df.where("split = 'dev'"), ["method"]), ["method"])
    rows = df.join(chosen, "method").withColumn("predicted", F.col("score") >= F.col("threshold"))
    return binary_metrics(rows, ["method", "strategy", "threshold", "split"])


def buckets(df: DataFrame, importance: str, by_split: str = "dev") -> DataFrame:
    """``bucket``: low, mid, high by the thirds of positive importance in the dev split; none where it isn't positive."""
    cut = df.where((F.col("split") == by_split) & (F.col(importance) > 0)).agg(F.percentile(importance, F.lit(1 / 3)).alias("_lo"), F.percentile(importance, F.lit(2 / 3)).alias("_hi"))
    x = F.col(importance)
    return df.crossJoin(F.broadcast(cut)).withColumn("bucket", F.when(~(x > 0) | x.isNull(), "none").when(x <= F.col("_lo"), "low").when(x <= F.col("_hi"), "mid").otherwise("high")).drop("_lo", "_hi")


def confusion(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts of true against predicted labels."""
    rows = df.where(F.col("actual").isin(list(labels))).groupBy("actual").pivot("guess", list(labels)).agg(F.count(F.lit(1)))
    return rows.na.fill(0)


def class_report(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, f1 and support by label."""
    hit = df.where("actual = guess").groupBy(F.col("actual").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("tp"))
    real = df.groupBy(F.col("actual").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("support"))
    said = df.groupBy(F.col("guess").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("said"))
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    rows = names.join(hit, "label", "left").join(real, "label", "left").join(said, "label", "left").na.fill(0.0)
    p, r = safe_div(F.col("tp"), F.col("said"), 0.0), safe_div(F.col("tp"), F.col("support"), 0.0)
    return rows.select("label", p.alias("precision"), r.alias("recall"), safe_div(2 * p * r, p + r, 0.0).alias("f1"), F.col("support").cast("long").alias("support"))


# Fusion


def decided(score: Column, brand_a: Column, brand_b: Column) -> Column:
    """different, duplicate or uncertain; brands that are known and differ decide."""
    a, b = norm(brand_a), norm(brand_b)
    return F.when((a != "") & (b != "") & (a != b), "different").when(score < DIFFERENT_BELOW, "different").when(score >= DUPLICATE_FROM, "duplicate").otherwise("uncertain")


def best_run(runs: DataFrame, strategy: str | None = None) -> DataFrame:
    """The run of the least cost; ties: false merges, false splits, f1 (higher), threshold (higher), name. Runs of the
    preferred strategy if there are any."""
    preferred = runs.where(F.col("strategy") == strategy) if strategy is not None and runs.where(F.col("strategy") == strategy).take(1) else runs
    return preferred.orderBy("cost", "fp", "fn", F.desc("f1"), F.desc("threshold"), "method", "strategy").limit(1)


def fusion_edges(pairs: DataFrame, threshold: float) -> DataFrame:
    """family_edge and pack_edge of scored pairs: a pack edge is a family edge between equal packs."""
    family = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return pairs.withColumns({"family_edge": family, "pack_edge": family & F.col("same_pack")})


def bcubed(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of predicted groups against true ones. ``df``: node, predicted, actual. Overlaps are
    counted group by group, so no node meets another."""
    both = df.groupBy("predicted", "actual").agg(F.count(F.lit(1)).cast("double").alias("o"))
    p = df.groupBy("predicted").agg(F.count(F.lit(1)).cast("double").alias("np"))
    t = df.groupBy("actual").agg(F.count(F.lit(1)).cast("double").alias("nt"))
    rows = both.join(p, "predicted").join(t, "actual")
    out = rows.agg((F.sum(F.col("o") * F.col("o") / F.col("np")) / F.sum("o")).alias("precision"), (F.sum(F.col("o") * F.col("o") / F.col("nt")) / F.sum("o")).alias("recall"))
    return out.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def component_flags(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``same_component`` of pairs (a, b)."""
    x = pairs.join(parts.toDF("a", "_ca"), "a", "left").join(parts.toDF("b", "_cb"), "b", "left")
    return x.withColumn("same_component", F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).drop("_ca", "_cb")


def with_sales(pairs: DataFrame, sales: DataFrame) -> DataFrame:
    """Sales of both sides: ``sales``: id, units; pairs: a, b."""
    return pairs.join(sales.toDF("a", "units_a"), "a", "left").join(sales.toDF("b", "units_b"), "b", "left")


# Splits


def stratified_split(df: DataFrame, key: str, stratum: Sequence[str], ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """``split`` by the order of a seeded hash within each stratum, cut at the rounded shares."""
    w = Window.partitionBy(*stratum)
    rows = df.withColumn("_o", hash_fraction(F.col(key), seed))
    rows = rows.withColumns({"_r": F.row_number().over(w.orderBy("_o", key)), "_n": F.count(F.lit(1)).over(w)})
    names, edge, split = list(ratios), 0.0, None
    for name in names[:-1]:
        edge += ratios[name]
        cut = F.col("_r") <= F.bround(F.col("_n") * edge, 0)
        split = F.when(cut, name) if split is None else split.when(cut, name)
    return rows.withColumn("split", split.otherwise(names[-1])).drop("_o", "_r", "_n")


def _parts(scratch: Scratch, pairs: DataFrame, name: str) -> DataFrame:
    parts = components(scratch, pairs.select("a", "b"), name)
    return parts.union(parts.select(F.col("component").alias("node"), "component").distinct())


def record_split(pairs: DataFrame, ratios: Mapping[str, float], positive: str = "positive", most_share: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pairs with ``split``, dropped pairs) such that no record is in two splits. Whole components of records, where the
    largest has at most ``most_share`` of all pairs; else whole components of positive pairs, and pairs between two
    splits are dropped."""
    scratch = Scratch(pairs.sparkSession, "record-split")
    whole = pairs.join(_parts(scratch, pairs, "all").withColumnRenamed("node", "a"), "a")
    most = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if not most["all"] or most["most"] <= most_share * most["all"]:
        return component_split(pairs, ratios, seed), pairs.limit(0)
    units = _parts(scratch, pairs.where(F.col(positive)), "positive")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sized = ends.join(units, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    placed = scratch.keep(_assigned(sized, ratios, seed), "placed")
    side = ends.distinct().join(units, "node", "left").withColumn("component", F.coalesce("component", "node")).join(placed, "component").select("node", "split")
    both = pairs.join(side.toDF("a", "split"), "a").join(side.toDF("b", "_other"), "b")
    return both.where("split = _other").drop("_other"), both.where("split <> _other").drop("split", "_other")


def component_split(pairs: DataFrame, ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """``split`` of pairs (a, b) such that no record is in two splits: whole components of records go to a split, by a
    seeded hash of the component against the shares of rows before it. Components are ranked in sorted ranges."""
    scratch = Scratch(pairs.sparkSession, "split")
    rows = pairs.join(_parts(scratch, pairs, "records").withColumnRenamed("node", "a"), "a")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(_assigned(sizes, ratios, seed), "component").drop("component")


def _before(df: DataFrame, order: Sequence[str], n: str, band: int = 10_000) -> DataFrame:
    """``df`` with ``_before``, the sum of ``n`` over the rows before it: sums of bands of places, then within a band."""
    from tallyforge.operators.identity import numbered

    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = numbered(df, order).withColumn("_band", F.floor(F.col("_k") / band))
    bands = rows.groupBy("_band").agg(F.sum(n).alias("_s"))
    bands = bands.withColumn("_s", earlier("_s", Window.orderBy("_band")))
    inner = rows.withColumn("_in", earlier(n, Window.partitionBy("_band").orderBy("_k")))
    return inner.join(bands, "_band").withColumn("_before", F.col("_s") + F.col("_in")).drop("_k", "_band", "_s", "_in")


def _assigned(sizes: DataFrame, ratios: Mapping[str, float], seed: int) -> DataFrame:
    """(component, split) by the share of rows before a component in the order of a seeded hash. ``sizes``: component, n."""
    total = sizes.agg(F.sum("n").alias("t"))
    before = _before(sizes.withColumn("o", hash_fraction(F.col("component"), seed)), ["o", "component"], "n")
    done = before.crossJoin(total).withColumn("share", F.col("_before") / F.col("t"))
    names, edge, split = list(ratios), 0.0, None
    for name in names[:-1]:
        edge += ratios[name]
        split = F.when(F.col("share") < edge, name) if split is None else split.when(F.col("share") < edge, name)
    return done.select("component", split.otherwise(names[-1]).alias("split"))


def leaking(df: DataFrame) -> DataFrame:
    """Records that are in more than one split. ``df``: a, b, split."""
    ends = df.select(F.col("a").alias("record"), "split").union(df.select("b", "split"))
    return ends.groupBy("record").agg(F.countDistinct("split").alias("n")).where("n > 1").select("record")


def limited(df: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """At most ``limit`` rows in all: each split its share, the remainder to the first splits by name."""
    splits = sorted(r[0] for r in df.select("split").distinct().collect())
    share = {s: limit // len(splits) + (k < limit % len(splits)) for k, s in enumerate(splits)} if splits else {}
    quota = F.create_map(*(F.lit(x) for kv in share.items() for x in kv)) if share else None
    w = Window.partitionBy("split").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota[F.col("split")]).drop("_r") if share else df


def round_robin(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows when the groups of ``by`` take turns."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_t", F.row_number().over(w) - 1).orderBy("_t", *by, *order).limit(n).drop("_t")


# Profiles


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, missing (share), distinct (values) of each column."""
    one = df.agg(*(x for c in columns for x in ((F.count_if(F.col(q(c)).isNull()) / F.count(F.lit(1))).alias(f"{c}__m"), F.countDistinct(F.col(q(c))).alias(f"{c}__d"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(q(f"{c}__m")).alias("missing"), F.col(q(f"{c}__d")).alias("distinct")) for c in columns))).alias("x")).select("x.*")


def ngram_counts(df: DataFrame, words: Column, n: int) -> DataFrame:
    """Counts of word n-grams."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    rows = df.where(F.size(words) >= n).select(F.explode(grams).alias("gram"))
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rank correlation of two columns, ties at their mean rank. Values are counted first and ranked as counts."""
    ranked = df
    for c in (a, b):
        counts = _before(df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [c], "_n")
        ranked = ranked.join(counts.select(c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_rank_{c}")), c)
    return ranked.agg(F.corr(f"_rank_{a}", f"_rank_{b}").alias("rho"))


def monthly(df: DataFrame, day: Column) -> DataFrame:
    """month, n, share and the mean of three months, with months that have none."""
    counts = df.select(F.trunc(day.cast("date"), "month").alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi"), F.sum("n").alias("total"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"), "total")
    rows = months.join(counts, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = F.avg("n").over(Window.orderBy("month").rowsBetween(-2, 0))
    return rows.select("month", "n", (F.col("n") / F.col("total")).alias("share"), mean.alias("mean3"))


def node_scores(pairs: DataFrame) -> DataFrame:
    """Statistics of the scores of a node's pairs (a, b, score)."""
    ends = pairs.select(F.col("a").alias("node"), "score").union(pairs.select("b", "score"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("edges"), F.max("score").alias("best"), F.min("score").alias("worst"))
