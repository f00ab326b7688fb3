"""Metrics, sweeps, rank statistics, audits and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import stats as St
from parleyspark.functions import text as T
from parleyspark.functions.hashing import hash_unit, stable_int
from parleyspark.operators import gates as G
from parleyspark.operators import metrics as M
from parleyspark.operators import mining as Mi
from parleyspark.operators import ranks as R
from parleyspark.plans import frames as B
from parleyspark.plans.registry import query
from parleyspark.plans.text_queries import CORRUPTED, corrupted
from parleyspark.session import cut_lineage, table

# abusive is y = 1 here; the labels say 0 = abusive
_Y = "(1 - label)"


def scored(spark, sf):
    """Narrow rows: y (1 abusive), g, h, kind."""
    kinds = F.array(*[F.lit(k) for k in ("utterance", "split", "benign_window", "camouflage")])
    key = F.col("doc_id").cast("string")
    kind = F.get(kinds, (stable_int(F.lit("kind"), key) % 4).cast("int"))
    return B.label_scores(spark, sf).withColumns({"y": 1 - F.col("label"), "kind": kind})


_KINDS = "['utterance', 'split', 'benign_window', 'camouflage']"
_SCORED = f"""{B.LABELLED}, sc AS (SELECT *, (1 - label) AS y, ({_KINDS})[{B.s_int("'kind|' || doc_id")} % 4 + 1] AS kind FROM lab)"""


def _s_metrics(keys: str, cte: str, empty_fpr: str = "NULL") -> str:
    return f"""SELECT {keys}, tp + fp + fn + tn AS n, tp + fn AS positives, {B.s_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
        p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1,
        {B.s_div('fp', 'tn + fp', empty_fpr)} AS fpr FROM (SELECT *, {B.s_div('tp', 'tp + fp')} AS p, {B.s_div('tp', 'tp + fn')} AS r FROM {cte})"""


def _s_confusion(keys: str, cte: str, pred: str, y: str = "y") -> str:
    n = lambda a, b: f"count(*) FILTER ({pred} = {a} AND {y} = {b})"
    return f"SELECT {keys}, {n(1, 1)} AS tp, {n(1, 0)} AS fp, {n(0, 1)} AS fn, {n(0, 0)} AS tn FROM {cte} GROUP BY {keys}"


@query(
    "binary_metrics",
    f"""WITH {_SCORED}, p AS (SELECT *, CASE WHEN g >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc), c AS ({_s_confusion('lang', 'p', 'pred')})
        {_s_metrics('lang', 'c')}""",
)
def binary_metrics(spark, sf):
    pred = F.when(F.col("g") >= 0.5, 1).otherwise(0)
    return M.binary_metrics(M.confusion(scored(spark, sf), ["lang"], F.col("y"), pred), ["lang"])


@query(
    "binary_metrics_spec",
    f"""WITH {_SCORED}, p AS (SELECT *, CASE WHEN h >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc), c AS ({_s_confusion('lang', 'p', 'pred')})
        {_s_metrics('lang', 'c', '1.0::DOUBLE')}""",
)
def binary_metrics_spec(spark, sf):
    """The variant whose false positive rate is one minus specificity."""
    pred = F.when(F.col("h") >= 0.5, 1).otherwise(0)
    return M.binary_metrics(M.confusion(scored(spark, sf), ["lang"], F.col("y"), pred), ["lang"], 1.0)


@query(
    "slice_metrics",
    f"""WITH {_SCORED}, p AS (SELECT *, CASE WHEN g >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc),
        s AS (SELECT *, unnest(list_filter([kind, CASE WHEN kind = 'split' AND h < 0.5 THEN 'split_slur_not_in_final_turn' END,
            CASE WHEN kind = 'split' AND h >= 0.5 THEN 'split_slur_in_final_turn' END, CASE WHEN h < 0.4::DOUBLE OR y = 0 THEN 'needs_context' END,
            CASE WHEN split = 'test' THEN 'test_split_only' END], lambda x: x IS NOT NULL)) AS slice FROM p),
        c AS ({_s_confusion('slice', 's', 'pred')}) {_s_metrics('slice', 'c')}""",
)
def slice_metrics(spark, sf):
    """Overlapping slices: each row names every slice it belongs to."""
    h, kind = F.col("h"), F.col("kind")
    names = F.array(
        kind,
        F.when((kind == "split") & (h < 0.5), "split_slur_not_in_final_turn"),
        F.when((kind == "split") & (h >= 0.5), "split_slur_in_final_turn"),
        F.when((h < 0.4) | (F.col("y") == 0), "needs_context"),
        F.when(F.col("split") == "test", "test_split_only"),
    )
    d = scored(spark, sf).withColumn("slice", F.explode(F.array_compact(names)))
    pred = F.when(F.col("g") >= 0.5, 1).otherwise(0)
    return M.binary_metrics(M.confusion(d, ["slice"], F.col("y"), pred), ["slice"])


@query(
    "confusion_matrix",
    f"""WITH {B.LABELLED}, p AS (SELECT *, (CASE WHEN g >= 0.5 THEN 0 ELSE 1 END)::BIGINT AS pred FROM lab)
        SELECT label, pred, count(*) AS n FROM p GROUP BY label, pred""",
)
def confusion_matrix(spark, sf):
    pred = F.when(F.col("g") >= 0.5, 0).otherwise(1).cast("bigint")
    return B.label_scores(spark, sf).groupBy("label", pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _s_classes(cte: str, keys: str, k: int) -> str:
    """Per-class counts with fixed classes, for (keys)."""
    return f"""SELECT {keys}, class_id, max(n) AS n, max(hit) AS hit, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
        SELECT {keys}, c.class_id, count(*) OVER (PARTITION BY {keys}, c.class_id) AS n, count(*) FILTER (y = pred) OVER (PARTITION BY {keys}, c.class_id) AS hit,
        (pred = c.class_id AND y = c.class_id)::INT AS tp, (pred = c.class_id AND y <> c.class_id)::INT AS fp, (pred <> c.class_id AND y = c.class_id)::INT AS fn
        FROM {cte}, (SELECT unnest(range({k})) AS class_id) c) GROUP BY {keys}, class_id"""


def _s_macro(keys: str, cte: str, k: int) -> str:
    return f"""SELECT {keys}, max(n)::BIGINT AS n, max(hit)::DOUBLE / max(n)::DOUBLE AS accuracy, round(sum(f) / {k}, 6) AS macro_f1,
        round(sum(p) / {k}, 6) AS macro_precision, round(sum(r) / {k}, 6) AS macro_recall FROM
        (SELECT *, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM
        (SELECT *, {B.s_div('tp', 'tp + fp')} AS p, {B.s_div('tp', 'tp + fn')} AS r FROM {cte})) GROUP BY {keys}"""


def round_macro(df):
    cols = ["macro_f1", "macro_precision", "macro_recall"]
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "macro_scores_binary",
    f"WITH {_SCORED}, p AS (SELECT split, y, CASE WHEN g >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc), c AS ({_s_classes('p', 'split', 2)}) {_s_macro('split', 'c', 2)}",
)
def macro_scores_binary(spark, sf):
    d = scored(spark, sf).withColumn("pred", F.when(F.col("g") >= 0.5, 1).otherwise(0))
    return round_macro(M.macro_scores(M.class_counts(d, ["split"], "y", "pred", range(2)), ["split"], 2))


def thread_predictions(spark, sf):
    """Threads with two stand-in five-class predictions."""
    th = B.threads(spark, sf)
    wrong = lambda tag: stable_int(F.lit(tag), F.col("thread_id")) % 10
    pred = lambda tag, bar: F.when(wrong(tag) < bar, F.col("label_id")).otherwise(wrong(tag + "2") % 5)
    return th.select(
        "thread_id", "length", "script", "label", "label_id", "pair_id", "n", "split",
        pred("isolated", 5).alias("isolated"), pred("thread", 7).alias("thread"),
    )


def _s_pred(tag, bar):
    return f"CASE WHEN {B.s_int(f"'{tag}|' || thread_id")} % 10 < {bar} THEN label_id ELSE ({B.s_int(f"'{tag}2|' || thread_id")} % 10) % 5 END"


_TPRED = f"{B.THREADS}, tp AS (SELECT *, {_s_pred('isolated', 5)} AS isolated, {_s_pred('thread', 7)} AS thread FROM th)"


@query(
    "macro_f1_by_group",
    f"""WITH {_TPRED}, p AS (SELECT 'all' AS grp, 'all' AS val, label_id AS y, thread AS pred FROM tp UNION ALL
        SELECT 'length', length::VARCHAR, label_id, thread FROM tp UNION ALL SELECT 'script', script, label_id, thread FROM tp),
        c AS ({_s_classes('p', 'grp, val', 5)}) {_s_macro('grp, val', 'c', 5)}""",
)
def macro_f1_by_group(spark, sf):
    d = thread_predictions(spark, sf)
    groups = F.array(
        F.struct(F.lit("all").alias("grp"), F.lit("all").alias("val")),
        F.struct(F.lit("length").alias("grp"), F.col("length").cast("string").alias("val")),
        F.struct(F.lit("script").alias("grp"), F.col("script").alias("val")),
    )
    d = d.select(F.explode(groups).alias("g"), F.col("label_id").alias("y"), F.col("thread").alias("pred")).select("g.grp", "g.val", "y", "pred")
    return round_macro(M.macro_scores(M.class_counts(d, ["grp", "val"], "y", "pred", range(5)), ["grp", "val"], 5))


@query(
    "per_class_recall",
    f"""WITH {_TPRED}, p AS (SELECT 1 AS one, label_id AS y, thread AS pred FROM tp), c AS ({_s_classes('p', 'one', 5)})
        SELECT class_id::BIGINT AS class_id, (tp + fn)::BIGINT AS support, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM c""",
)
def per_class_recall(spark, sf):
    d = thread_predictions(spark, sf)
    c = M.class_counts(d, [], "label_id", "thread", range(5))
    tp, fn = F.col("tp"), F.col("fn")
    return c.select(F.col("class_id").cast("bigint").alias("class_id"), (tp + fn).alias("support"), M.ratio(tp, tp + fn, None).alias("recall"))


@query("confusion_five", f"WITH {_TPRED} SELECT label_id, thread AS pred, count(*) AS n FROM tp GROUP BY label_id, thread")
def confusion_five(spark, sf):
    return thread_predictions(spark, sf).groupBy("label_id", F.col("thread").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


# --- sweeps ------------------------------------------------------------------------------
def _grid(name):
    return M.linspace(*name)


@query(
    "threshold_sweep",
    f"""WITH {_SCORED}, gr AS (SELECT unnest({B.numbers(_grid(C.SLICE_GRID))}) AS t),
        a AS (SELECT t, kind, count(*) FILTER ((g >= t) = (y = 1))::DOUBLE / count(*)::DOUBLE AS acc FROM sc, gr GROUP BY t, kind),
        m AS (SELECT t, round(avg(acc), 9) AS mean_accuracy FROM a GROUP BY t)
        SELECT t AS threshold, mean_accuracy, row_number() OVER (ORDER BY mean_accuracy DESC, t) = 1 AS best FROM m""",
)
def threshold_sweep(spark, sf):
    from pyspark.sql import Window as W

    swept = M.sweep(scored(spark, sf), ["kind"], F.col("y"), F.col("g"), _grid(C.SLICE_GRID))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    acc = swept.withColumn("acc", M.ratio(tp + tn, tp + fp + fn + tn))
    mean = acc.groupBy("threshold").agg(F.round(F.avg("acc"), 9).alias("mean_accuracy"))
    first = F.row_number().over(W.orderBy(F.desc("mean_accuracy"), "threshold")) == 1
    return mean.withColumn("best", first)


@query(
    "fpr_capped_threshold",
    f"""WITH {_SCORED}, gr AS (SELECT unnest({B.numbers(_grid(C.CAPPED_GRID))}) AS t),
        a AS (SELECT t, count(*) FILTER (kind = 'benign_window' AND g >= t)::DOUBLE / count(*) FILTER (kind = 'benign_window')::DOUBLE AS fpr,
            count(*) FILTER (kind = 'split' AND g >= t)::DOUBLE / count(*) FILTER (kind = 'split')::DOUBLE AS rec,
            count(*) FILTER (kind = 'utterance' AND (g >= t) = (y = 1))::DOUBLE / count(*) FILTER (kind = 'utterance')::DOUBLE AS acc FROM sc, gr GROUP BY t)
        SELECT t AS threshold, fpr, rec AS recall, acc AS accuracy, round(rec + acc, 9) AS objective FROM a WHERE fpr <= 0.15::DOUBLE
        ORDER BY objective DESC, t LIMIT 1""",
)
def fpr_capped_threshold(spark, sf):
    swept = M.sweep(scored(spark, sf), ["kind"], F.col("y"), F.col("g"), _grid(C.CAPPED_GRID))
    at = lambda k, c: F.sum(F.when(F.col("kind") == k, c).otherwise(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rates = swept.groupBy("threshold").agg(
        M.ratio(at("benign_window", tp + fp), at("benign_window", n)).alias("fpr"),
        M.ratio(at("split", tp + fp), at("split", n)).alias("recall"),
        M.ratio(at("utterance", tp + tn), at("utterance", n)).alias("accuracy"),
    )
    ok = rates.filter(F.col("fpr") <= 0.15).withColumn("objective", F.round(F.col("recall") + F.col("accuracy"), 9))
    return M.first_max(ok, [], "objective", "threshold")


_F1 = "CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END"


@query(
    "half_split_f1",
    f"""WITH {_SCORED}, hs AS (SELECT *, {B.s_int("'half|' || doc_id")} % 2 AS half FROM sc), gr AS (SELECT unnest({B.numbers(_grid(C.HALF_GRID))}) AS t),
        c AS (SELECT lang, half, t, count(*) FILTER (g >= t AND y = 1) AS tp, count(*) FILTER (g >= t AND y = 0) AS fp, count(*) FILTER (g < t AND y = 1) AS fn FROM hs, gr GROUP BY ALL),
        f AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {B.s_div('tp', 'tp + fp')} AS p, {B.s_div('tp', 'tp + fn')} AS r FROM c)),
        b AS (SELECT lang, t FROM f WHERE half = 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, t) = 1)
        SELECT lang, t AS threshold, p AS precision, r AS recall, f1 FROM f JOIN b USING (lang, t) WHERE half = 1""",
)
def half_split_f1(spark, sf):
    """Threshold picked on one hash half, reported on the other."""
    half = stable_int(F.lit("half"), F.col("doc_id").cast("string")) % 2
    swept = M.sweep(scored(spark, sf).withColumn("half", half), ["lang", "half"], F.col("y"), F.col("g"), _grid(C.HALF_GRID))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    swept = swept.withColumns({"precision": M.ratio(tp, tp + fp), "recall": M.ratio(tp, tp + fn)})
    swept = swept.withColumn("f1", M.f1(F.col("precision"), F.col("recall")))
    best = M.first_max(swept.filter("half = 0"), ["lang"], "f1", "threshold").select("lang", "step")
    return swept.filter("half = 1").join(best, ["lang", "step"]).select("lang", "threshold", "precision", "recall", "f1")


# --- gate benchmark ------------------------------------------------------------------------
def graded(spark, sf):
    """Labelled rows as graded items: truth by hash, raw and rank-matched score drops."""
    removed = stable_int(F.lit("truth"), F.col("doc_id").cast("string")) % 2 == 0
    d = B.labelled(spark, sf).withColumn("removed", removed)
    d = d.withColumns({"drop_raw": F.col("h") - F.col("g"), "no_lexicon": ~G.has_stem(F.col("text"))}).drop("text")
    d = R.ecdf_at(d, "h", d, "h", "f_src")
    d = R.ecdf_at(B.label_scores(spark, sf).select("g"), "g", d, "g", "f_out")
    return cut_lineage(d.withColumn("drop_rank", F.col("f_src") - F.col("f_out")))


_GRADED = f"""{B.LABELLED}, ec AS (SELECT *, cume_dist() OVER (ORDER BY h) AS f_src, cume_dist() OVER (ORDER BY g) AS f_out FROM lab),
    gd AS (SELECT *, {B.s_int("'truth|' || doc_id")} % 2 = 0 AS removed, h - g AS drop_raw, f_src - f_out AS drop_rank, NOT {B.s_has_stem('text')} AS no_lexicon FROM ec)"""


@query("ecdf_rank_drop", f"WITH {_GRADED} SELECT doc_id, f_src, f_out, drop_raw, drop_rank FROM gd")
def ecdf_rank_drop(spark, sf):
    return graded(spark, sf).select("doc_id", "f_src", "f_out", "drop_raw", "drop_rank")


def _s_youden(score: str) -> str:
    return f"""(WITH t AS (SELECT DISTINCT round_even({score} * 1000, 0) / 1000 AS thr FROM gd),
        s AS (SELECT thr, count(*) FILTER (removed AND {score} > thr)::DOUBLE / count(*) FILTER (removed)::DOUBLE
            - count(*) FILTER (NOT removed AND {score} > thr)::DOUBLE / count(*) FILTER (NOT removed)::DOUBLE AS j FROM gd, t GROUP BY thr)
        SELECT thr, j FROM s ORDER BY j DESC, thr LIMIT 1)"""


@query(
    "youden",
    f"WITH {_GRADED} SELECT 'drop_raw' AS score, thr AS threshold, j FROM {_s_youden('drop_raw')} UNION ALL SELECT 'drop_rank', thr, j FROM {_s_youden('drop_rank')}",
)
def youden(spark, sf):
    d = graded(spark, sf).select("removed", "drop_raw", "drop_rank")
    return M.youden(d, F.col("removed"), ["drop_raw", "drop_rank"])


@query(
    "gate_arm_table",
    f"""WITH {_GRADED}, g2 AS (SELECT split AS variant, removed, unnest([{{'gate': 'lexicon', 'reject': no_lexicon}}, {{'gate': 'raw_drop', 'reject': drop_raw > 0.15::DOUBLE}},
        {{'gate': 'either', 'reject': no_lexicon OR drop_raw > 0.15::DOUBLE}}, {{'gate': 'rank_drop', 'reject': drop_rank > 0.15::DOUBLE}}]) AS x FROM gd),
        c AS (SELECT x.gate AS gate, variant, count(*) AS n, count(*) FILTER (x.reject) AS rejected, count(*) FILTER (removed) AS n_removed,
        count(*) FILTER (x.reject AND removed) AS rejected_removed, count(*) FILTER (x.reject AND NOT removed) AS rejected_kept FROM g2 GROUP BY ALL)
        SELECT *, rejected::DOUBLE / n::DOUBLE AS reject_rate, {B.s_div('rejected_removed', 'n_removed', 'NULL')} AS sensitivity, {B.s_div('rejected_kept', 'n - n_removed', 'NULL')} AS false_reject,
        {B.s_div('rejected_removed', 'n_removed', 'NULL')} - {B.s_div('rejected_kept', 'n - n_removed', 'NULL')} AS youden_j FROM c""",
)
def gate_arm_table(spark, sf):
    d = graded(spark, sf).withColumnRenamed("split", "variant")
    raw, lex, rank = F.col("drop_raw") > 0.15, F.col("no_lexicon"), F.col("drop_rank") > 0.15
    return M.gate_table(d, F.col("removed"), {"lexicon": lex, "raw_drop": raw, "either": lex | raw, "rank_drop": rank}, "variant")


@query(
    "corruption_gate",
    f"""WITH {CORRUPTED}, x AS (SELECT *, NOT {B.s_preserved('src', 'text')} AS lex, NOT {B.s_preserved('src', 'text', True)} AS folded FROM bench)
        SELECT variant, truth, count(*) AS n, count(*) FILTER (lex) AS hand_rejects, count(*) FILTER (folded) AS folded_rejects FROM x GROUP BY variant, truth""",
)
def corruption_gate(spark, sf):
    """Lexicon gate against corruptions with known truth."""
    d = corrupted(spark, sf)
    src, text = F.col("src"), F.col("text")
    return d.groupBy("variant", "truth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~G.lexicon_preserved(src, text)).alias("hand_rejects"),
        F.count_if(~G.lexicon_preserved(src, text, folded_only=True)).alias("folded_rejects"),
    )


_AUC = """r AS (SELECT lang, y, g, rank() OVER (PARTITION BY lang ORDER BY g) + (count(*) OVER (PARTITION BY lang, g) - 1) / 2.0::DOUBLE AS rk FROM {cte})
    SELECT lang, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
    CASE WHEN count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 THEN round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1)::DOUBLE * (count(*) FILTER (y = 1) + 1) / 2)
      / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)::DOUBLE), 9) END AS auc FROM r GROUP BY lang"""


@query("auc_midrank", f"WITH {_SCORED}, {_AUC.format(cte='sc')}")
def auc_midrank(spark, sf):
    """Ties take their average rank."""
    d = scored(spark, sf)
    return R.auc(d, ["lang"], F.col("y") == 1, "g").withColumn("auc", F.round("auc", 9))


@query(
    "gate_validity",
    f"""WITH {_SCORED}, u AS (SELECT split, y, CASE WHEN {B.s_int("'null|' || doc_id")} % 9 > 0 THEN g END AS g FROM sc), k AS (SELECT * FROM u WHERE g IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY g) + (count(*) OVER (PARTITION BY split, g) - 1) / 2.0::DOUBLE AS rk FROM k),
        a AS (SELECT split, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1)::DOUBLE * (count(*) FILTER (y = 1) + 1) / 2)
            / nullif(count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)::DOUBLE, 0), 9) AS auc,
            count(*) FILTER ((g >= 0.5) = (y = 1))::DOUBLE / count(*)::DOUBLE AS acc_at_half FROM r GROUP BY split)
        SELECT split, (SELECT count(*) FROM u WHERE u.split = a.split) AS n, auc, acc_at_half FROM a""",
)
def gate_validity(spark, sf):
    """AUC and accuracy at one half per split; missing scores are left out."""
    missing = stable_int(F.lit("null"), F.col("doc_id").cast("string")) % 9 == 0
    d = scored(spark, sf).withColumn("g", F.when(~missing, F.col("g")))
    auc = R.auc(d, ["split"], F.col("y") == 1, "g").select("split", F.round("auc", 9).alias("auc"))
    hit = F.count_if((F.col("g") >= 0.5) == (F.col("y") == 1))
    acc = d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), M.ratio(hit, F.count("g")).alias("acc_at_half"))
    return acc.join(auc, "split").select("split", "n", "auc", "acc_at_half")


# --- buckets and tests --------------------------------------------------------------------
def bucketed(spark, sf):
    d = T.with_mixing(B.labelled(spark, sf))
    pred = F.when(F.col("g") >= 0.5, 0).otherwise(1)
    return d.select("doc_id", "label", "cmi", "h", "g", "split", pred.alias("pred"), T.mix_bucket(F.col("cmi")).alias("bucket"))


_BUCKETED = f"""{B.LABELLED}, {B.s_mixing('lab', 'mixed')}, bt AS (SELECT doc_id, label, cmi, h, g, split, CASE WHEN g >= 0.5 THEN 0 ELSE 1 END AS pred, {B.s_bucket('cmi')} AS bucket FROM mixed)"""


def _s_wilson(k: str, n: str) -> tuple[str, str]:
    z, zz = "1.96::DOUBLE", f"{1.96 * 1.96!r}::DOUBLE"
    p, nd = f"(({k})::DOUBLE / ({n})::DOUBLE)", f"({n})::DOUBLE"
    d, c = f"(1.0::DOUBLE + {zz} / {nd})", f"({p} + {zz} / (2.0::DOUBLE * {nd}))"
    h = f"({z} * sqrt({p} * (1.0::DOUBLE - {p}) / {nd} + {zz} / (4.0::DOUBLE * {nd} * {nd})))"
    wrap = lambda e: f"CASE WHEN ({n}) > 0 THEN round({e}, 9) ELSE 0.0::DOUBLE END"
    return wrap(f"({c} - {h}) / {d}"), wrap(f"({c} + {h}) / {d}")


_LO, _HI = _s_wilson("hit", "n")


@query(
    "cmi_bucket_metrics",
    f"""WITH {_BUCKETED}, b AS (SELECT bucket, count(*) AS n, count(*) FILTER (pred = label) AS hit, count(*) FILTER (label = 0) AS n_abusive,
        count(*) FILTER (label = 0 AND pred = 0) AS hit_abusive FROM bt GROUP BY bucket)
        SELECT bucket, n, 100.0::DOUBLE * n::DOUBLE / (SELECT count(*) FROM bt)::DOUBLE AS share_pct, hit::DOUBLE / n::DOUBLE AS accuracy,
        {_LO} AS ci_low, {_HI} AS ci_high, n_abusive, {B.s_div('hit_abusive', 'n_abusive', 'NULL')} AS recall_abusive FROM b""",
)
def cmi_bucket_metrics(spark, sf):
    """Does mixing depth predict failure: accuracy, interval and recall per bucket.

    The texts are read once; shares come from the five bucket rows.
    """
    from pyspark.sql import Window as W

    b = bucketed(spark, sf).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pred") == F.col("label")).alias("hit"),
        F.count_if(F.col("label") == 0).alias("n_abusive"),
        F.count_if((F.col("label") == 0) & (F.col("pred") == 0)).alias("hit_abusive"),
    )
    total = F.sum("n").over(W.partitionBy())
    lo, hi = M.wilson(F.col("hit"), F.col("n"))
    return b.select(
        "bucket", "n",
        (F.lit(100.0) * F.col("n").cast("double") / total.cast("double")).alias("share_pct"),
        M.ratio(F.col("hit"), F.col("n")).alias("accuracy"),
        F.round(lo, 9).alias("ci_low"), F.round(hi, 9).alias("ci_high"),
        "n_abusive", M.ratio(F.col("hit_abusive"), F.col("n_abusive"), None).alias("recall_abusive"),
    )


def fixed_buckets(spark):
    """The fixed bucket list with its order, as a five-row frame."""
    arr = F.array(*[F.lit(b) for b in C.CMI_BUCKETS])
    return spark.range(1).select(F.posexplode(arr).alias("pos", "bucket"))


def recall_counts(spark, sf):
    abusive, clean = F.col("label") == 0, F.col("label") == 1
    c = bucketed(spark, sf).groupBy("bucket").agg(
        F.count_if(abusive).alias("n_abusive"),
        F.count_if(abusive & (F.col("pred") == 0)).alias("hit"),
        F.count_if(clean).alias("n_clean"),
        F.count_if(clean & (F.col("pred") == 1)).alias("spec_hit"),
    )
    return fixed_buckets(spark).join(F.broadcast(c), "bucket", "left").na.fill(0)


_RB = f"""{_BUCKETED}, fb AS (SELECT unnest(range(5)) AS pos, unnest({B.words(C.CMI_BUCKETS)}) AS bucket),
    rc AS (SELECT fb.pos, fb.bucket, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 0 AND pred = 0) AS hit,
    count(*) FILTER (label = 1) AS n_clean, count(*) FILTER (label = 1 AND pred = 1) AS spec_hit FROM fb LEFT JOIN bt ON fb.bucket = bt.bucket GROUP BY ALL)"""


@query(
    "recall_by_bucket",
    f"""WITH {_RB} SELECT bucket, n AS n_abusive, {B.s_div('hit', 'n', 'NULL')} AS recall, {_LO} AS ci_low, {_HI} AS ci_high,
        n_clean, {B.s_div('spec_hit', 'n_clean', 'NULL')} AS specificity FROM rc""",
)
def recall_by_bucket(spark, sf):
    c = recall_counts(spark, sf)
    lo, hi = M.wilson(F.col("hit"), F.col("n_abusive"))
    return c.select(
        "bucket", "n_abusive", M.ratio(F.col("hit"), F.col("n_abusive"), None).alias("recall"),
        F.round(lo, 9).alias("ci_low"), F.round(hi, 9).alias("ci_high"),
        "n_clean", M.ratio(F.col("spec_hit"), F.col("n_clean"), None).alias("specificity"),
    )


@query(
    "trend_statistic",
    f"""WITH {_RB}, x AS (SELECT pos, n, CASE WHEN n > 0 THEN round_even(round_even(hit::DOUBLE / n::DOUBLE, 4) * n, 0) ELSE 0 END AS x FROM rc),
        s AS (SELECT sum(n)::DOUBLE AS nn, sum(x) AS xx, sum(pos * x) AS sx, sum(n * pos)::DOUBLE AS sn, sum(n * pos * pos)::DOUBLE AS ssn FROM x)
        SELECT nn AS n, xx AS x, round((sx - xx / nn * sn) ** 2 / nullif(xx / nn * (1 - xx / nn) * (ssn - sn * sn / nn), 0), 6) AS chi2 FROM s""",
)
def trend_statistic(spark, sf):
    """Trend of abuse recall over mixing depth."""
    c = recall_counts(spark, sf)
    rounded = F.rint(M.ratio(F.col("hit"), F.col("n_abusive")) * 10000) / 10000
    c = c.withColumn("x", F.rint(rounded * F.col("n_abusive")))
    return M.trend_chi2(c, "pos", "n_abusive", "x").withColumn("chi2", F.round("chi2", 6))


def model_rows(spark, sf):
    """Three stand-in predictions per row."""
    key = F.col("doc_id").cast("string")
    d = B.label_scores(spark, sf)
    return d.select("doc_id", "label", *[
        F.when(hash_unit(F.lit(m), key) >= 0.5, 0).otherwise(1).alias(m) for m in ("shipped", "layer1", "synth")
    ])


def mcnemar_table(spark, sf):
    d = model_rows(spark, sf)
    right = F.col("shipped") == F.col("label")
    arms = F.array(*[F.struct(F.lit(m).alias("other"), F.col(m).alias("p")) for m in ("layer1", "synth")])
    d = d.select("label", right.alias("a"), "shipped", F.explode(arms).alias("x"))
    ok = F.col("x.p") == F.col("label")
    return d.groupBy(F.col("x.other").alias("other")).agg(
        F.count_if(F.col("a") & ~ok).alias("b"), F.count_if(~F.col("a") & ok).alias("c"),
        F.count_if(F.col("shipped") != F.col("x.p")).alias("disagree"),
        F.round(F.avg(F.col("a").cast("double")) - F.avg(ok.cast("double")), 9).alias("diff"),
    )


_MODELS = f"""{B.LABELLED}, md AS (SELECT doc_id, label, {', '.join(f"CASE WHEN {B.s_unit(f"'{m}|' || doc_id")} >= 0.5 THEN 0 ELSE 1 END AS {m}" for m in ('shipped', 'layer1', 'synth'))} FROM lab),
    mm AS (SELECT *, unnest([{{'other': 'layer1', 'p': layer1}}, {{'other': 'synth', 'p': synth}}]) AS x FROM md),
    mc AS (SELECT x.other AS other, count(*) FILTER (shipped = label AND x.p <> label) AS b, count(*) FILTER (shipped <> label AND x.p = label) AS c,
    count(*) FILTER (shipped <> x.p) AS disagree, round(avg((shipped = label)::INT::DOUBLE) - avg((x.p = label)::INT::DOUBLE), 9) AS diff FROM mm GROUP BY x.other)"""
_LCH = lambda n, k: f"(lgamma(({n}) + 1.0) - lgamma(({k}) + 1.0) - lgamma(({n}) - ({k}) + 1.0))"


@query(
    "mcnemar",
    f"""WITH {_MODELS} SELECT other, b, c, disagree, diff, CASE WHEN b + c > 0 THEN (abs(b - c) - 1.0::DOUBLE) * (abs(b - c) - 1.0::DOUBLE) / (b + c)::DOUBLE ELSE 0.0::DOUBLE END AS chi2,
        CASE WHEN b = c THEN 1.0::DOUBLE ELSE round(least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp({_LCH('b + c', 'i')} - (b + c) * ln(2.0))))), 6) END AS p_exact FROM mc""",
)
def mcnemar(spark, sf):
    m = mcnemar_table(spark, sf)
    b, c = F.col("b"), F.col("c")
    step = F.abs(b - c).cast("double") - 1.0
    chi2 = F.when(b + c > 0, step * step / (b + c).cast("double")).otherwise(0.0)
    return m.withColumns({"chi2": chi2, "p_exact": F.round(St.binomial_p(b, b + c), 6)})


@query("p_values")
def p_values(spark, sf):
    """chi-square, trend, rank-sum and rank-correlation p-values of the audits."""
    m = mcnemar_table(spark, sf)
    b, c = F.col("b"), F.col("c")
    step = F.abs(b - c).cast("double") - 1.0
    chi = m.select(F.concat(F.lit("mcnemar:"), "other").alias("test"), F.try_divide(step * step, (b + c).cast("double")).alias("statistic"))
    chi = chi.unionByName(trend_statistic(spark, sf).select(F.lit("trend").alias("test"), F.col("chi2").alias("statistic")))
    chi = chi.withColumn("p", St.chi2_p("statistic"))
    mw = mann_whitney_stats(spark, sf).select(F.lit("rank_sum").alias("test"), F.col("z").alias("statistic"), St.upper_normal_p("z").alias("p"))
    sp = spearman_stats(spark, sf).select(F.lit("spearman").alias("test"), F.col("rho").alias("statistic"), St.corr_p("rho", "n").alias("p"))
    return chi.unionByName(mw).unionByName(sp)


@query(
    "fisher_table",
    f"""WITH {_BUCKETED}, t AS (SELECT count(*) FILTER (cmi < 10 AND pred = label) AS a, count(*) FILTER (cmi < 10 AND pred <> label) AS b,
        count(*) FILTER (cmi >= 20 AND pred = label) AS c, count(*) FILTER (cmi >= 20 AND pred <> label) AS d FROM bt),
        l AS (SELECT *, list_transform(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1), lambda x: {_LCH('a + b', 'x')} + {_LCH('c + d', 'a + c - x')} - {_LCH('a + b + c + d', 'a + c')}) AS lp,
        {_LCH('a + b', 'a')} + {_LCH('c + d', 'c')} - {_LCH('a + b + c + d', 'a + c')} + 1e-7 AS obs FROM t)
        SELECT a, b, c, d, CASE WHEN b * c > 0 THEN (a * d)::DOUBLE / (b * c)::DOUBLE END AS odds,
        round(least(1.0, list_sum(list_transform(list_filter(lp, lambda v: v <= obs), lambda v: exp(v)))), 6) AS p FROM l""",
)
def fisher_table(spark, sf):
    low, deep, ok = F.col("cmi") < 10, F.col("cmi") >= 20, F.col("pred") == F.col("label")
    t = bucketed(spark, sf).agg(
        F.count_if(low & ok).alias("a"), F.count_if(low & ~ok).alias("b"), F.count_if(deep & ok).alias("c"), F.count_if(deep & ~ok).alias("d")
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    return t.select("a", "b", "c", "d", M.ratio(a * d, b * c, None).alias("odds"), F.round(St.fisher_p("a", "b", "c", "d"), 6).alias("p"))


def mann_whitney_stats(spark, sf):
    """Mixing index of rows the score gate drops against rows it keeps."""
    d = cut_lineage(bucketed(spark, sf).select("cmi", "h", "g"))
    dropped = ~(F.col("g") >= F.col("h") - C.SCORE_DELTA)
    return R.mann_whitney(d, dropped, "cmi")


@query(
    "mann_whitney",
    f"""WITH {_BUCKETED}, v AS (SELECT cmi, NOT (g >= h - 0.15::DOUBLE) AS a FROM bt),
        r AS (SELECT *, rank() OVER (ORDER BY cmi) + (count(*) OVER (PARTITION BY cmi) - 1) / 2.0::DOUBLE AS rk FROM v),
        s AS (SELECT count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, sum(rk) FILTER (a) AS rs FROM r),
        t AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM v GROUP BY cmi))
        SELECT n1::BIGINT AS n_first, n2::BIGINT AS n_second, rs - n1 * (n1 + 1) / 2 AS u,
        round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s, t""",
)
def mann_whitney(spark, sf):
    return mann_whitney_stats(spark, sf).withColumn("z", F.round("z", 6))


def spearman_stats(spark, sf):
    return R.spearman(cut_lineage(bucketed(spark, sf).select("cmi", "g")), "cmi", "g")


@query(
    "spearman",
    f"""WITH {_BUCKETED}, r AS (SELECT rank() OVER (ORDER BY cmi) + (count(*) OVER (PARTITION BY cmi) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0::DOUBLE AS y FROM bt) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""",
)
def spearman(spark, sf):
    return spearman_stats(spark, sf).withColumn("rho", F.round("rho", 6))


@query(
    "spearman_prices",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem)
        SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""",
)
def spearman_prices(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return R.spearman(d, "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query(
    "cmi_kept_vs_dropped",
    f"""WITH {_BUCKETED}, k AS (SELECT *, CASE WHEN label = 0 AND NOT (g >= h - 0.15::DOUBLE) THEN 'quarantined' ELSE 'kept' END AS population FROM bt)
        SELECT population, bucket, count(*) AS n, round(avg(cmi), 6) AS mean_cmi, round(avg(g), 6) AS mean_out, round(avg(h), 6) AS mean_src FROM k GROUP BY population, bucket""",
)
def cmi_kept_vs_dropped(spark, sf):
    gone = (F.col("label") == 0) & ~(F.col("g") >= F.col("h") - C.SCORE_DELTA)
    d = bucketed(spark, sf).withColumn("population", F.when(gone, "quarantined").otherwise("kept"))
    return d.groupBy("population", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("cmi"), 6).alias("mean_cmi"),
        F.round(F.avg("g"), 6).alias("mean_out"), F.round(F.avg("h"), 6).alias("mean_src"),
    )


@query(
    "pearson_scores",
    f"WITH {B.LABELLED} SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(coalesce(corr(h, g), 0.0), 6) ELSE 0.0 END::DOUBLE AS r FROM lab GROUP BY lang",
)
def pearson_scores(spark, sf):
    return B.label_scores(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(M.guarded_corr("h", "g"), 6).alias("r"))


_CAND = ", ".join(f"{{'candidate': '{m}', 'p': {B.s_unit(f"'{m}|' || doc_id")}}}" for m in ("shipped", "layer1", "synth"))


@query(
    "candidate_mad",
    f"""WITH {B.LABELLED}, x AS (SELECT g, unnest([{_CAND}]) AS c FROM lab), m AS (SELECT c.candidate AS candidate, round(avg(abs(c.p - g)), 9) AS mad, round(corr(c.p, g), 6) AS r FROM x GROUP BY ALL)
        SELECT *, row_number() OVER (ORDER BY mad, candidate) = 1 AS closest FROM m""",
)
def candidate_mad(spark, sf):
    """Which candidate reproduces the cached scores best."""
    from pyspark.sql import Window as W

    key = F.col("doc_id").cast("string")
    cands = F.array(*[F.struct(F.lit(m).alias("candidate"), hash_unit(F.lit(m), key).alias("p")) for m in ("shipped", "layer1", "synth")])
    d = B.label_scores(spark, sf).select("g", F.inline(cands))
    m = d.groupBy("candidate").agg(F.round(F.avg(F.abs(F.col("p") - F.col("g"))), 9).alias("mad"), F.round(M.guarded_corr("p", "g"), 6).alias("r"))
    return m.withColumn("closest", F.row_number().over(W.orderBy("mad", "candidate")) == 1)


@query(
    "contamination_curve",
    f"""WITH {_GRADED}, o AS (SELECT count(*) FILTER (removed AND drop_raw > 0.15::DOUBLE)::DOUBLE / count(*) FILTER (removed)::DOUBLE AS tpr,
        count(*) FILTER (NOT removed AND drop_raw > 0.15::DOUBLE)::DOUBLE / count(*) FILTER (NOT removed)::DOUBLE AS fpr FROM gd),
        g AS (SELECT unnest({B.numbers(C.SOFTENING_GRID)}) AS s)
        SELECT s, s * (1.0::DOUBLE - tpr) / (s * (1.0::DOUBLE - tpr) + (1.0::DOUBLE - s) * (1.0::DOUBLE - fpr)) AS contamination FROM g, o""",
)
def contamination_curve(spark, sf):
    t = M.gate_table(graded(spark, sf), F.col("removed"), {"raw": F.col("drop_raw") > 0.15})
    rates = t.select(F.explode(F.array(*[F.lit(s) for s in C.SOFTENING_GRID])).alias("s"), "sensitivity", "false_reject")
    s, one = F.col("s"), F.lit(1.0)
    missed = s * (one - F.col("sensitivity"))
    return rates.select("s", (missed / (missed + (one - s) * (one - F.col("false_reject")))).alias("contamination"))


@query(
    "annotator_votes",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n, avg((value > 40)::INT::DOUBLE) AS ab, avg((value <= 40 AND value > 5)::INT::DOUBLE) AS not_ab FROM events GROUP BY ALL)
        SELECT user_id, event_type, n, ab, (ab >= 0.5)::INT::BIGINT AS y FROM v WHERE NOT (ab > 0.25 AND ab < 0.5) AND NOT (ab < 0.5 AND not_ab < 0.5)""",
)
def annotator_votes(spark, sf):
    """Vote shares per item; items the voters disagree on are dropped."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    share = lambda c: F.avg(c.cast("int").cast("double"))
    v = e.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("value") > 40).alias("ab"), share((F.col("value") <= 40) & (F.col("value") > 5)).alias("not_ab")
    )
    ab = F.col("ab")
    unclear = ((ab > 0.25) & (ab < 0.5)) | ((ab < 0.5) & (F.col("not_ab") < 0.5))
    return v.filter(~unclear).select("user_id", "event_type", "n", "ab", (ab >= 0.5).cast("bigint").alias("y"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    t = M.gate_table(graded(spark, sf), F.col("removed"), {"raw": F.col("drop_raw") > 0.15, "lexicon": F.col("no_lexicon")})
    t = t.withColumn("ci", St.bootstrap_ci("rejected_removed", "n_removed"))
    return t.select("gate", "sensitivity", "ci.low", "ci.high")


_PROMO = " UNION ALL ".join(f"SELECT '{m}' AS mix, {i} AS pos, avg(({m} = label)::INT::DOUBLE) AS acc FROM md" for i, m in enumerate(("layer1", "synth")))


@query(
    "promotion",
    f"""WITH {_MODELS}, a AS ({_PROMO}), b AS (SELECT * FROM a ORDER BY round(acc, 9) DESC, pos DESC LIMIT 1), s AS (SELECT avg((shipped = label)::INT::DOUBLE) AS cur FROM md)
        SELECT mix, round(acc, 9) AS accuracy, round(cur, 9) AS current, acc > cur + 1e-6 AS promote FROM b, s""",
)
def promotion(spark, sf):
    """Best new mix (later wins ties) against the current accuracy."""
    d = model_rows(spark, sf)
    acc = lambda m: F.avg((F.col(m) == F.col("label")).cast("int").cast("double"))
    wide = d.agg(acc("layer1").alias("layer1"), acc("synth").alias("synth"), acc("shipped").alias("current"))
    arms = F.array(*[F.struct(F.lit(m).alias("mix"), F.lit(i).alias("pos"), F.col(m).alias("acc")) for i, m in enumerate(("layer1", "synth"))])
    rows = wide.select("current", F.inline(arms))
    best = rows.orderBy(F.desc(F.round("acc", 9)), F.desc("pos")).limit(1)
    return best.select("mix", F.round("acc", 9).alias("accuracy"), F.round("current", 9).alias("current"), (F.col("acc") > F.col("current") + 1e-6).alias("promote"))


# --- mining ------------------------------------------------------------------------------
_MINE = f"""{B.LABELLED}, tk AS (SELECT label, unnest(list_distinct(list_filter({B.s_content('text')}, lambda t: length(t) >= 4 AND NOT list_contains({B.words(C.ENGLISH_WORDS)}, t)))) AS token FROM lab),
    ct AS (SELECT token, count(*) FILTER (label = 0) AS a, count(*) FILTER (label <> 0) AS b FROM tk GROUP BY token),
    sz AS (SELECT count(*) FILTER (label = 0)::DOUBLE AS na, count(*) FILTER (label <> 0)::DOUBLE AS nb FROM lab),
    lo AS (SELECT token, a, b, ln((a + 0.5) / (na + 0.5)) - ln((b + 0.5) / (nb + 0.5)) AS lo FROM ct, sz
        WHERE a + b >= 12 AND NOT (a / greatest(na, 1) > 0.35::DOUBLE AND b / greatest(nb, 1) > 0.35::DOUBLE))"""


@query(
    "stem_log_odds",
    f"""WITH {_MINE} SELECT * FROM (SELECT token, a, b, round(lo, 6) AS log_odds, 'abuse' AS side FROM lo WHERE lo > 0 ORDER BY round(lo, 9) DESC, token DESC LIMIT 12)
        UNION ALL SELECT * FROM (SELECT token, a, b, round(lo, 6), 'benign' FROM lo WHERE lo < 0 ORDER BY round(lo, 9), token LIMIT 6)""",
)
def stem_log_odds(spark, sf):
    d = B.labelled(spark, sf)
    out = Mi.log_odds_stems(d, "text", F.col("label") == 0, min_docs=12)
    return out.select("token", "a", "b", F.round("log_odds", 6).alias("log_odds"), "side")


_WORDS = f"regexp_extract_all(lower(text), {B.lit(C.LATIN_WORD)})"
_DIR = f"""{B.LABELLED}, tk AS (SELECT label, unnest(list_distinct({_WORDS})) AS token FROM lab),
    vc AS (SELECT token, count(*) FILTER (label = 0) AS a, count(*) FILTER (label <> 0) AS b FROM tk GROUP BY token HAVING count(*) >= 12),
    sm AS (SELECT sum(a)::DOUBLE AS n0, sum(b)::DOUBLE AS n1 FROM vc),
    y AS (SELECT token, a, b, n0, n1, a + 500.0::DOUBLE * (a + b)::DOUBLE / (n0 + n1) AS y0, b + 500.0::DOUBLE * (a + b)::DOUBLE / (n0 + n1) AS y1 FROM vc, sm),
    z AS (SELECT token, a, b, (ln(y0 / (n0 + 500.0::DOUBLE - y0)) - ln(y1 / (n1 + 500.0::DOUBLE - y1))) / sqrt(1.0::DOUBLE / y0 + 1.0::DOUBLE / y1) AS z FROM y)"""


def latin_words():
    return F.regexp_extract_all(F.lower("text"), F.lit(C.LATIN_WORD), F.lit(0))


@query("dirichlet_log_odds", f"WITH {_DIR} SELECT token, a, b, round(z, 6) AS z FROM z ORDER BY round(z.z, 9) DESC, token LIMIT 250")
def dirichlet_log_odds(spark, sf):
    t = Mi.dirichlet_terms(B.labelled(spark, sf), latin_words(), F.col("label") == 0)
    return t.select("token", "a", "b", F.round("z", 6).alias("z"))


_STOP = sorted(set(C.BASE_WORDS) | set(C.ENGLISH_WORDS))


@query(
    "term_alignment",
    f"""WITH {_DIR}, terms AS (SELECT token FROM z ORDER BY round(z.z, 9) DESC, token LIMIT 12),
        pr AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS src, list_distinct(list_filter(regexp_extract_all(lower(substr(text, length(text) // 2 + 1)), {B.lit(C.LATIN_WORD)}), lambda w: length(w) >= 3)) AS ws FROM lab),
        bg AS (SELECT word, count(*) AS bg FROM (SELECT unnest(ws) AS word FROM pr) GROUP BY word),
        hits AS (SELECT token AS term, ws FROM pr JOIN terms ON contains(src, token)), dn AS (SELECT term, count(*) AS docs FROM hits GROUP BY term HAVING count(*) >= 5),
        k AS (SELECT term, word, count(*) AS k FROM (SELECT term, unnest(ws) AS word FROM hits) WHERE NOT list_contains({B.words(_STOP)}, word) GROUP BY ALL HAVING count(*) >= 3),
        s AS (SELECT k.term, k.word, k, docs, bg, ln((k::DOUBLE / docs) / (bg::DOUBLE / (SELECT count(*) FROM pr))) * ln(1 + k::DOUBLE) AS w FROM k JOIN dn ON k.term = dn.term JOIN bg ON k.word = bg.word
            WHERE k::DOUBLE / docs::DOUBLE > bg::DOUBLE / (SELECT count(*) FROM pr)::DOUBLE * 3)
        SELECT term, word, k, docs, round(w, 6) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(w, 9) DESC, word DESC) <= 6""",
)
def term_alignment(spark, sf):
    lab = B.labelled(spark, sf)
    terms = Mi.dirichlet_terms(lab, latin_words(), F.col("label") == 0, top_k=12)
    terms = [r["token"] for r in terms.select("token").collect()]  # at most twelve
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = lab.select("doc_id", F.substr("text", F.lit(1), half).alias("src"), F.substr(F.col("text"), half + 1).alias("out"))
    a = Mi.align_terms(pairs, "src", "out", terms)
    return a.select("term", "word", "k", "docs", F.round("weight", 6).alias("weight"))
