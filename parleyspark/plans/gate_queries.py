"""Gate chains, accept / quarantine routing, cleaning and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import replies as P
from parleyspark.functions import similarity as S
from parleyspark.functions import text as T
from parleyspark.functions.hashing import stable_int
from parleyspark.operators import dedup as D
from parleyspark.operators import gates as G
from parleyspark.operators import metrics as M
from parleyspark.operators import sampling as Sa
from parleyspark.plans import frames as B
from parleyspark.plans.registry import query
from parleyspark.session import cut_lineage


@query(
    "hard_check_reasons",
    f"WITH {B.GATED}, n AS (SELECT *, {B.s_hard('source', 'reply', False)} AS basic FROM gated) "
    "SELECT attempt::BIGINT AS attempt, hard, basic, count(*)::BIGINT AS n FROM n GROUP BY ALL",
)
def hard_check_reasons(spark, sf):
    r = B.replies(spark, sf).select("attempt", "source", T.clean_reply(F.col("raw")).alias("reply"))
    src, out = F.col("source"), F.col("reply")
    checked = r.select(
        F.col("attempt").cast("bigint").alias("attempt"),
        G.hard_check(src, out).alias("hard"),
        G.hard_check(src, out, with_lexicon=False).alias("basic"),
    )
    return checked.groupBy("attempt", "hard", "basic").agg(F.count(F.lit(1)).alias("n"))


def outcomes(spark, sf):
    return G.resolve_attempts(B.replies(spark, sf), ["doc_id", "split"])


@query(
    "conversion_outcome",
    f"WITH {B.RESOLVED} SELECT doc_id, split, label, status, fail_reason, attempts, md5(text) AS text_hash, "
    "md5(last_output) AS last_hash, h, g, score_delta FROM outcome",
)
def conversion_outcome(spark, sf):
    return outcomes(spark, sf).select(
        "doc_id", "split", "label", "status", "fail_reason", "attempts",
        F.md5("text").alias("text_hash"), F.md5("last_output").alias("last_hash"), "h", "g", "score_delta",
    )


@query(
    "conversion_report",
    f"""WITH {B.RESOLVED} SELECT split, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status <> 'accepted') AS quarantined,
        CASE WHEN count(*) FILTER (label = 0) > 0 THEN count(*) FILTER (label = 0 AND status = 'accepted')::DOUBLE / count(*) FILTER (label = 0)::DOUBLE END AS abusive_accept_rate,
        round(avg(score_delta) FILTER (status = 'accepted'), 6) AS mean_score_delta,
        100.0::DOUBLE * count(*) FILTER (status = 'accepted')::DOUBLE / greatest(count(*), 1)::DOUBLE AS yield_pct FROM outcome GROUP BY split""",
)
def conversion_report(spark, sf):
    ok, abusive = F.col("status") == "accepted", F.col("label") == 0
    n_ok, n = F.count_if(ok), F.count(F.lit(1))
    return outcomes(spark, sf).groupBy("split").agg(
        n_ok.alias("accepted"),
        F.count_if(~ok).alias("quarantined"),
        M.ratio(F.count_if(abusive & ok), F.count_if(abusive), None).alias("abusive_accept_rate"),
        F.round(F.avg(F.when(ok, F.col("score_delta"))), 6).alias("mean_score_delta"),
        (F.lit(100.0) * n_ok.cast("double") / F.greatest(n, F.lit(1)).cast("double")).alias("yield_pct"),
    )


@query(
    "quarantine_histogram",
    f"WITH {B.RESOLVED} SELECT fail_reason, count(*) AS n FROM outcome WHERE status <> 'accepted' GROUP BY fail_reason ORDER BY n DESC, fail_reason LIMIT 20",
)
def quarantine_histogram(spark, sf):
    q = outcomes(spark, sf).filter("status <> 'accepted'")
    return q.groupBy("fail_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fail_reason").limit(20)


_SLACK = " + ".join(f"CASE WHEN NOT (g >= h - {d!r}::DOUBLE) THEN 1 ELSE 0 END" for d in C.DELTA_GRID)


@query(
    "acceptance_curve",
    f"""WITH {B.LABELLED}, grid AS (SELECT unnest({B.numbers(C.DELTA_GRID)}) AS delta),
        r AS (SELECT delta, 100.0::DOUBLE * (count(*) FILTER (g >= h - delta))::DOUBLE / count(*)::DOUBLE AS accept_pct
              FROM lab, grid WHERE label = 0 GROUP BY delta)
        SELECT delta, accept_pct, accept_pct - lag(accept_pct) OVER (ORDER BY delta) AS marginal_gain FROM r""",
)
def acceptance_curve(spark, sf):
    """Each row is reduced to the first delta that accepts it; the curve is a
    running total of that histogram."""
    from pyspark.sql import Window as W

    d = B.label_scores(spark, sf).filter("label = 0")
    passed = F.lit(0)
    for delta in C.DELTA_GRID:
        passed = passed + F.when(F.col("g") >= F.col("h") - F.lit(delta), 0).otherwise(1)
    hist = d.groupBy(passed.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    deltas = F.array(*[F.lit(x) for x in C.DELTA_GRID])
    steps = hist.select("first", "n", F.posexplode(deltas).alias("i", "delta"))
    rate = F.lit(100.0) * F.sum(F.when(F.col("first") <= F.col("i"), F.col("n")).otherwise(0)).cast("double")
    curve = steps.groupBy("delta").agg((rate / F.sum("n").cast("double")).alias("accept_pct"))
    return curve.withColumn("marginal_gain", F.col("accept_pct") - F.lag("accept_pct").over(W.orderBy("delta")))


@query(
    "lexicon_coverage",
    f"""WITH {B.LABELLED} SELECT split, count(*) AS n, count(*) FILTER ({B.s_has_stem('text')}) AS covered,
        count(*) FILTER ({B.s_has_stem('text')})::DOUBLE / count(*)::DOUBLE AS share FROM lab WHERE label = 0 GROUP BY split""",
)
def lexicon_coverage(spark, sf):
    has = G.has_stem(F.col("text"))
    d = B.labelled(spark, sf).filter("label = 0")
    return d.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has).alias("covered"), M.ratio(F.count_if(has), F.count(F.lit(1))).alias("share")
    )


@query(
    "resume_pending",
    f"""WITH {B.LABELLED}, done AS (SELECT doc_id FROM lab WHERE h < 0.3::DOUBLE UNION SELECT doc_id FROM lab WHERE g < 0.2::DOUBLE)
        SELECT split, count(*) AS pending, min(doc_id) AS first_id FROM lab WHERE doc_id NOT IN (SELECT doc_id FROM done) GROUP BY split""",
)
def resume_pending(spark, sf):
    d = B.label_scores(spark, sf)
    left = D.pending(d, d.filter("h < 0.3D"), d.filter("g < 0.2D"), key="doc_id")
    return left.groupBy("split").agg(F.count(F.lit(1)).alias("pending"), F.min("doc_id").alias("first_id"))


_REASON = (
    "CASE k WHEN 0 THEN 'ThrottlingException' WHEN 1 THEN 'api_error:Timeout' WHEN 2 THEN 'abuse_score_drop' "
    "WHEN 3 THEN 'refusal' ELSE 'abuse_lexicon_missing' END"
)


@query(
    "release_quarantine",
    f"""WITH {B.LABELLED}, q AS (SELECT doc_id, split, {_REASON} AS fail_reason FROM (SELECT *, {B.s_int("'q|' || doc_id")} % 5 AS k FROM lab))
        SELECT split, count(*) AS before, count(*) FILTER (NOT released) AS after, count(*) FILTER (released) AS released FROM
        (SELECT *, contains(fail_reason, 'Throttl') OR starts_with(fail_reason, 'api_error') OR fail_reason = 'abuse_score_drop' AS released FROM q) GROUP BY split""",
)
def release_quarantine(spark, sf):
    k = stable_int(F.lit("q"), F.col("doc_id").cast("string")) % 5
    reason = F.when(k == 0, "ThrottlingException").when(k == 1, "api_error:Timeout").when(k == 2, "abuse_score_drop")
    q = B.label_scores(spark, sf).withColumn("fail_reason", reason.when(k == 3, "refusal").otherwise("abuse_lexicon_missing"))
    out = G.released(F.col("fail_reason"))
    return q.groupBy("split").agg(
        F.count(F.lit(1)).alias("before"), F.count_if(~out).alias("after"), F.count_if(out).alias("released")
    )


@query(
    "reprocess_quarantine",
    f"""WITH {B.RESOLVED}, q AS (SELECT * FROM outcome WHERE status <> 'accepted'), again AS (SELECT doc_id, split, label, source AS text FROM rep
        WHERE attempt = 0 AND doc_id IN (SELECT doc_id FROM q WHERE fail_reason = 'abuse_score_drop'))
        SELECT 'reprocess' AS part, doc_id, split, label, md5(text) AS text_hash FROM again UNION ALL
        SELECT 'keep', doc_id, split, label, md5(last_output) FROM q WHERE doc_id NOT IN (SELECT doc_id FROM again)""",
)
def reprocess_quarantine(spark, sf):
    """Rows taken back for another run leave the stored quarantine."""
    q = cut_lineage(outcomes(spark, sf).filter("status <> 'accepted'"))
    ids = q.filter("fail_reason = 'abuse_score_drop'").select("doc_id")
    source = B.labelled(spark, sf).select("doc_id", "split", "label", "text").join(ids, "doc_id", "left_semi")
    again = source.select(F.lit("reprocess").alias("part"), "doc_id", "split", "label", F.md5("text").alias("text_hash"))
    keep = q.join(ids, "doc_id", "left_anti").select(
        F.lit("keep").alias("part"), "doc_id", "split", "label", F.md5("last_output").alias("text_hash")
    )
    return again.unionByName(keep)


# --- cleaning of the train split -----------------------------------------------------
_CLEAN = f"""{B.LABELLED}, tr AS (SELECT *, {B.s_norm('text')} AS norm FROM lab WHERE split = 'train'),
    ho AS (SELECT DISTINCT {B.s_norm('text')} AS norm FROM lab WHERE split <> 'train'),
    why AS (SELECT *, CASE WHEN norm IN ({', '.join(B.lit(s) for s in C.SHOT_TEXTS)}) THEN 'fewshot_leak'
        WHEN label = 1 AND g >= 0.5 AND g > h + 0.15::DOUBLE THEN 'abuse_score_spike'
        WHEN norm = '' OR norm IN (SELECT norm FROM ho) THEN 'holdout_or_empty' END AS drop_reason FROM tr),
    kept AS (SELECT * FROM why WHERE drop_reason IS NULL QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1),
    judged AS (SELECT *, {B.s_int("'judge|' || doc_id")} AS j FROM kept),
    rel AS (SELECT *, (j % 2)::BIGINT AS judge_label, (j % 1000)::DOUBLE / 1000.0::DOUBLE AS confidence,
        (label = 0 AND h < 0.1::DOUBLE AND g < 0.2::DOUBLE) OR (label = 1 AND h > 0.7::DOUBLE AND g > 0.7::DOUBLE) AS disagrees FROM judged),
    fin AS (SELECT *, disagrees AND confidence >= 0.7::DOUBLE AND judge_label = (CASE WHEN g >= 0.5 THEN 0 ELSE 1 END) AND judge_label <> label AS flip FROM rel)"""


def norm_rows(spark, sf):
    """Labelled rows with norm keys in place of texts; texts are read once."""
    shots = [t.strip().lower() for t in C.SHOT_TEXTS]
    lab = B.labelled(spark, sf).withColumn("is_shot", T.normalise(F.col("text")).isin(shots))
    return cut_lineage(D.with_norm(lab.select("doc_id", "label", "split", "h", "g", "is_shot", "text")))


def clean_train(rows):
    """(train rows with the first drop reason, the rows that stay)."""
    train, held = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    reason = G.first_failure(
        [
            ("fewshot_leak", F.col("is_shot")),
            ("abuse_score_spike", G.non_abusive_spike(F.col("label"), F.col("h"), F.col("g"))),
            ("holdout_or_empty", F.col("in_holdout")),
        ],
        None,
    )
    marked = D.mark_holdout(train, held).withColumn("drop_reason", reason).drop("in_holdout")
    return marked, D.first_per_text(marked.filter("drop_reason IS NULL"), ["doc_id"])


@query("dropped_row_log", f"WITH {_CLEAN} SELECT doc_id, label, drop_reason FROM why WHERE drop_reason IS NOT NULL")
def dropped_row_log(spark, sf):
    marked, _ = clean_train(norm_rows(spark, sf))
    return marked.filter("drop_reason IS NOT NULL").select("doc_id", "label", "drop_reason")


@query("train_dedup_first", f"WITH {_CLEAN} SELECT doc_id, label, split FROM kept")
def train_dedup_first(spark, sf):
    return clean_train(norm_rows(spark, sf))[1].select("doc_id", "label", "split")


def relabelled(kept):
    """Judge verdicts flip a label only when confident, agreed and different."""
    j = stable_int(F.lit("judge"), F.col("doc_id").cast("string"))
    verdict = kept.select("doc_id", (j % 2).alias("judge_label"), ((j % 1000).cast("double") / 1000.0).alias("confidence"))
    h, g, label = F.col("h"), F.col("g"), F.col("label")
    rows = kept.join(verdict, "doc_id", "left")
    flip = (
        G.scores_disagree(label, h, g)
        & (F.col("confidence") >= 0.7)
        & G.scorer_agrees(F.col("judge_label"), g)
        & (F.col("judge_label") != label)
    )
    return rows.withColumn("flip", F.coalesce(flip, F.lit(False)))


@query(
    "relabel_apply",
    f"WITH {_CLEAN} SELECT doc_id, label AS old_label, CASE WHEN flip THEN judge_label ELSE label END AS new_label, flip FROM fin",
)
def relabel_apply(spark, sf):
    r = relabelled(clean_train(norm_rows(spark, sf))[1])
    return r.select("doc_id", F.col("label").alias("old_label"), F.when(F.col("flip"), F.col("judge_label")).otherwise(F.col("label")).alias("new_label"), "flip")


@query(
    "clean_report",
    f"""WITH {_CLEAN} SELECT (SELECT count(*) FROM tr) AS train_in, count(*) FILTER (drop_reason = 'fewshot_leak') AS fewshot_leak,
        count(*) FILTER (drop_reason = 'abuse_score_spike') AS abuse_score_spike, count(*) FILTER (drop_reason = 'holdout_or_empty') AS holdout_or_empty,
        (SELECT count(*) FROM why WHERE drop_reason IS NULL) - (SELECT count(*) FROM kept) AS train_dups,
        (SELECT count(*) FROM fin WHERE flip) AS relabeled, (SELECT count(*) FROM kept) AS train_out FROM why""",
)
def clean_report(spark, sf):
    marked, kept = clean_train(norm_rows(spark, sf))
    n = lambda r: F.count_if(F.col("drop_reason") == r).alias(r)
    dropped = marked.agg(
        F.count(F.lit(1)).alias("train_in"), n("fewshot_leak"), n("abuse_score_spike"), n("holdout_or_empty"),
        F.count_if(F.col("drop_reason").isNull()).alias("_open"),
    )
    out = relabelled(kept).agg(F.count(F.lit(1)).alias("train_out"), F.count_if("flip").alias("relabeled"))
    both = dropped.withColumn("_one", F.lit(1)).join(out.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "train_in", "fewshot_leak", "abuse_score_spike", "holdout_or_empty",
        (F.col("_open") - F.col("train_out")).alias("train_dups"), "relabeled", "train_out",
    )


@query(
    "merge_rescued",
    f"""WITH {_CLEAN}, resc AS (SELECT doc_id + 1000000000 AS doc_id, label, text, {B.s_norm('text')} AS norm FROM lab WHERE g > 0.6::DOUBLE),
        un AS (SELECT doc_id, label, norm, 0 AS src FROM kept UNION ALL SELECT doc_id, label, norm, 1 FROM resc),
        m AS (SELECT * FROM un WHERE norm NOT IN (SELECT norm FROM ho) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY src, doc_id) = 1)
        SELECT doc_id, label, 'train' AS split, src::BIGINT AS src FROM m""",
)
def merge_rescued(spark, sf):
    """Rescued rows of every split join train, after the holdout and duplicate tests."""
    rows = norm_rows(spark, sf)
    part = lambda d, src: d.select("doc_id", "label", "norm", "blank", F.lit(src).cast("bigint").alias("src"))
    rescued = rows.filter("g > 0.6D").withColumn("doc_id", F.col("doc_id") + 1000000000)
    both = part(clean_train(rows)[1], 0).unionByName(part(rescued, 1))
    open_rows = D.mark_holdout(both, rows.filter("split <> 'train'")).filter(~F.col("in_holdout"))
    merged = D.first_per_text(open_rows, ["src", "doc_id"])
    return merged.select("doc_id", "label", F.lit("train").alias("split"), "src")


@query(
    "spike_and_disagreement",
    f"""WITH {B.LABELLED} SELECT label, count(*) FILTER (label = 1 AND g >= 0.5 AND g > h + 0.15::DOUBLE) AS spikes,
        count(*) FILTER ((label = 0 AND h < 0.1::DOUBLE AND g < 0.2::DOUBLE) OR (label = 1 AND h > 0.7::DOUBLE AND g > 0.7::DOUBLE)) AS disagree,
        round(avg(h), 6) AS mean_h, round(avg(g), 6) AS mean_g, round(avg(h - g), 6) AS mean_delta FROM lab GROUP BY label""",
)
def spike_and_disagreement(spark, sf):
    label, h, g = F.col("label"), F.col("h"), F.col("g")
    return B.label_scores(spark, sf).groupBy("label").agg(
        F.count_if(G.non_abusive_spike(label, h, g)).alias("spikes"),
        F.count_if(G.scores_disagree(label, h, g)).alias("disagree"),
        F.round(F.avg(h), 6).alias("mean_h"), F.round(F.avg(g), 6).alias("mean_g"), F.round(F.avg(h - g), 6).alias("mean_delta"),
    )


# --- hard-variant selection -----------------------------------------------------------
KINDS = ("paraphrase", "obfuscation", "contrastive")
_SEEDS = f"""{B.LABELLED}, seeds AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {B.s_int("'42|' || doc_id")}, doc_id) AS rn FROM lab WHERE split <> 'test'),
    jobs AS (SELECT doc_id, label, text AS seed_text, g, kind, 'synth-' || doc_id || '-' || kind AS vid,
        {B.s_int("'variant|' || doc_id || '|' || kind")} AS r, CASE WHEN kind = 'contrastive' THEN 1 - label ELSE label END AS want
        FROM seeds, (SELECT unnest({B.words(KINDS)}) AS kind) WHERE rn <= {C.SEEDS_PER_SPLIT}),
    gen AS (SELECT *, CASE r % 5 WHEN 0 THEN seed_text WHEN 1 THEN left(seed_text, 16) WHEN 2 THEN reverse(seed_text) ELSE seed_text || ' ' || kind || ' ' || (r % 3) END AS text,
        ((r // 7) % 2)::BIGINT AS judge_label, ((r // 11) % 1000)::DOUBLE / 1000.0::DOUBLE AS judge_conf FROM jobs),
    ban AS (SELECT DISTINCT {B.s_norm('text')} AS norm FROM lab),
    chk AS (SELECT *, {B.s_norm('text')} AS norm, {B.s_hard('seed_text', 'text')} AS hard FROM gen),
    c1 AS (SELECT *, CASE WHEN hard <> 'ok' THEN hard WHEN norm = {B.s_norm('seed_text')} THEN 'dup_or_identity'
        WHEN want = 0 AND kind <> 'obfuscation' AND NOT {B.s_preserved('seed_text', 'text')} THEN 'abuse_lexicon_missing'
        WHEN norm IN (SELECT norm FROM ban) THEN 'dup_or_identity' END AS early FROM chk)"""


@query("variant_acceptance")
def variant_acceptance(spark, sf):
    """Seeds capped per origin, one job per seed and kind, then the ordered gate.

    Cheap gates run first; the cosine only sees rows they let through. The
    global cap is a rank by key, not a race.
    """
    lab = B.labelled(spark, sf)
    seeds = Sa.sample_per_group(lab.filter("split <> 'test'"), ["split"], "doc_id", C.SEEDS_PER_SPLIT, 42)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    key = F.col("doc_id").cast("string")
    jobs = seeds.select("doc_id", "label", F.col("text").alias("seed_text"), F.explode(kinds).alias("kind"))
    r = stable_int(F.lit("variant"), key, F.col("kind"))
    jobs = jobs.withColumns(
        {
            "vid": F.concat_ws("-", F.lit("synth"), key, "kind"),
            "r": r,
            "want": F.when(F.col("kind") == "contrastive", 1 - F.col("label")).otherwise(F.col("label")),
        }
    )
    step, seed = F.col("r") % 5, F.col("seed_text")
    text = (
        F.when(step == 0, seed).when(step == 1, F.left(seed, F.lit(16))).when(step == 2, F.reverse(seed))
        .otherwise(F.concat_ws(" ", seed, "kind", (F.col("r") % 3).cast("string")))
    )
    gen = jobs.withColumns(
        {
            "text": text,
            "judge_label": F.floor(F.col("r") / 7) % 2,
            "judge_conf": (F.floor(F.col("r") / 11) % 1000).cast("double") / 1000.0,
        }
    )
    banned = lab.select(D.norm_key(F.col("text")).alias("_norm")).distinct().withColumn("_banned", F.lit(True))
    gen = gen.withColumn("_norm", D.norm_key(F.col("text"))).join(banned, "_norm", "left")
    early = G.first_failure(
        [
            *[(reason, p) for reason, p in G.hard_rules(seed, F.col("text"))],
            ("dup_or_identity", F.col("_norm") == D.norm_key(seed)),
            ("abuse_lexicon_missing", (F.col("want") == 0) & (F.col("kind") != "obfuscation") & ~G.lexicon_preserved(seed, F.col("text"))),
            ("dup_or_identity", F.coalesce("_banned", F.lit(False))),
        ],
        None,
    )
    open_text = lambda c: F.when(F.col("early").isNull(), F.col(c)).alias(c)
    gen = gen.withColumn("early", early).select(
        "vid", "kind", "want", "early", "_norm", "judge_label", "judge_conf", open_text("seed_text"), open_text("text")
    )
    gen = cut_lineage(gen)
    survivors = gen.filter("early IS NULL").withColumn("cosine", S.ngram_cosine(seed, F.col("text")))
    late = G.first_failure(
        [
            (F.concat(F.lit("low_cosine:"), F.format_string("%.2f", "cosine")), (F.col("kind") != "contrastive") & (F.col("cosine") < 0.55)),
            ("judge_unreliable", F.col("judge_conf") < 0.6),
            (F.concat(F.lit("judge_mismatch:"), F.col("judge_label").cast("string")), F.col("judge_label") != F.col("want")),
        ],
        None,
    )
    survivors = cut_lineage(survivors.withColumn("late", late).drop("text", "seed_text"))
    passed = D.first_wins(survivors.filter("late IS NULL"), ["_norm"], ["vid"])
    capped = passed if C.ACCEPTED_VARIANTS is None else passed.orderBy("vid").limit(C.ACCEPTED_VARIANTS)
    accepted = capped.select("vid", F.lit(True).alias("_in"))
    final = survivors.join(accepted, "vid", "left").withColumn(
        "fail_reason", F.coalesce("late", F.when(F.col("_in"), "accepted").otherwise("cap_or_race_dup"))
    )
    failed = gen.filter("early IS NOT NULL").select("vid", "kind", "want", F.col("early").alias("fail_reason"))
    return final.select("vid", "kind", "want", "fail_reason").unionByName(failed)


@query(
    "variant_early_gate",
    f"WITH {_SEEDS} SELECT kind, want, coalesce(early, 'open') AS reason, count(*) AS n FROM c1 GROUP BY ALL",
)
def variant_early_gate(spark, sf):
    v = variant_acceptance(spark, sf)
    early = F.col("fail_reason").rlike("^(low_cosine|judge_|cap_or|accepted)")
    return v.groupBy("kind", "want", F.when(early, "open").otherwise(F.col("fail_reason")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- error analysis --------------------------------------------------------------------
_ERR = f"""{B.LABELLED}, pr AS (SELECT *, (CASE WHEN g >= 0.5 THEN 0 ELSE 1 END)::BIGINT AS pred,
    regexp_replace(text, 'clown|trash', 'xx', 'g') AS out FROM lab),
    er AS (SELECT *, CASE WHEN label = pred THEN 'ok' WHEN label = 0 THEN 'fn' ELSE 'fp' END AS error, g >= 0.4 AND g <= 0.6 AS borderline FROM pr),
    hv AS (SELECT *, regexp_extract_all(out, {B.lit(C.LATIN_WORD)}) AS ws FROM er),
    bk AS (SELECT *, CASE WHEN error = 'ok' THEN 'ok'
        WHEN (label = 0 AND h < 0.1::DOUBLE AND g < 0.2::DOUBLE) OR (label = 1 AND h > 0.8::DOUBLE AND g > 0.8::DOUBLE) THEN 'source_label_wrong'
        WHEN label = 0 AND text <> '' AND NOT {B.s_preserved('text', 'out')} THEN 'softened_slur'
        WHEN regexp_matches(out, {B.lit(C.OBFUSCATED_TERMS)}) OR (contains(out, '.') AND {B.s_has_stem('text')}) THEN 'obfuscation'
        WHEN regexp_matches(out, {B.lit(C.GROUP_TERMS)}) OR regexp_matches(text, {B.lit(C.GROUP_TERMS)}) THEN 'caste_religious'
        WHEN len(ws) >= 4 AND len(list_filter(ws, lambda x: list_contains({B.words(C.ENGLISH_FUNCTION_WORDS)}, lower(x))))::DOUBLE / greatest(len(ws), 1)::DOUBLE >= 0.35::DOUBLE THEN 'english_heavy_mix'
        WHEN regexp_matches(out, {B.lit(C.SARCASM_TERMS)}) THEN 'sarcasm'
        WHEN label = 0 AND pred = 1 THEN 'benign_looking_insult' WHEN label = 1 AND pred = 0 THEN 'false_positive_other' ELSE 'other' END AS bucket FROM hv)"""


def error_rows(spark, sf):
    d = B.labelled(spark, sf).withColumns(
        {
            "pred": F.when(F.col("g") >= 0.5, 0).otherwise(1).cast("bigint"),
            "out": F.regexp_replace("text", "clown|trash", "xx"),
        }
    )
    kind = G.error_kind(F.col("label"), F.col("pred"))
    bucket = G.error_bucket(F.col("label"), F.col("pred"), F.col("text"), F.col("out"), F.col("h"), F.col("g"))
    d = d.withColumns({"error": kind, "borderline": G.borderline(F.col("g"))})
    return d.withColumn("bucket", F.when(F.col("error") == "ok", "ok").otherwise(bucket))


@query("error_buckets", f"WITH {_ERR} SELECT split, error, bucket, count(*) AS n, count(*) FILTER (borderline) AS n_borderline FROM bk GROUP BY ALL")
def error_buckets(spark, sf):
    return error_rows(spark, sf).groupBy("split", "error", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("borderline").alias("n_borderline")
    )


@query(
    "error_samples",
    f"""WITH {_ERR}, e AS (SELECT * FROM bk WHERE error <> 'ok'),
        k AS (SELECT 'kind' AS by, error AS value, doc_id, left(text, 240) AS text FROM e QUALIFY row_number() OVER (PARTITION BY error ORDER BY doc_id) <= 40),
        b AS (SELECT 'bucket' AS by, bucket AS value, doc_id, left(text, 200) AS text FROM e QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY doc_id) <= 8)
        SELECT * FROM k UNION ALL SELECT * FROM b""",
)
def error_samples(spark, sf):
    e = error_rows(spark, sf).filter("error <> 'ok'").select("doc_id", "error", "bucket", F.left("text", F.lit(240)).alias("text"))
    kinds = Sa.top_per_group(e, ["error"], ["doc_id"], 40).select(F.lit("kind").alias("by"), F.col("error").alias("value"), "doc_id", "text")
    buckets = Sa.top_per_group(e, ["bucket"], ["doc_id"], 8).select(
        F.lit("bucket").alias("by"), F.col("bucket").alias("value"), "doc_id", F.left("text", F.lit(200)).alias("text")
    )
    return kinds.unionByName(buckets)


@query(
    "blind_stratum",
    f"""WITH {B.LABELLED}, b AS (SELECT doc_id, g, length(text) AS n_chars, row_number() OVER (ORDER BY {B.s_int("'11|' || doc_id")}, doc_id) AS rn
        FROM lab WHERE label = 0 AND NOT {B.s_has_stem('text')} AND length(text) BETWEEN 15 AND 2200) SELECT doc_id, g, n_chars FROM b WHERE rn <= 250""",
)
def blind_stratum(spark, sf):
    d = B.labelled(spark, sf).filter("label = 0").filter(~G.has_stem(F.col("text")) & F.length("text").between(15, 2200))
    return Sa.sample(d.select("doc_id", "g", F.length("text").cast("bigint").alias("n_chars")), "doc_id", 250, 11)


# --- thread and chat gates ---------------------------------------------------------------
def _s_script() -> str:
    share = lambda ws: f"len(list_filter(wd, lambda x: list_contains({B.words(ws)}, x)))::DOUBLE / len(wd)::DOUBLE"
    return f"""CASE WHEN script = 'hindi_devanagari' THEN dev >= 10 AND dev::DOUBLE / greatest(dev + lat, 1)::DOUBLE >= 0.85::DOUBLE
        WHEN dev > 0 OR len(wd) = 0 THEN false WHEN script = 'english' THEN {share(C.STRICT_SCRIPT_WORDS)} < 0.04::DOUBLE
        ELSE {share(C.MARKED_SCRIPT_WORDS)} >= 0.15::DOUBLE END"""


_VALID = f"""{B.THREADS}, j AS (SELECT *, array_to_string(turns, ' ') AS joined, list_transform(turns, lambda t: {B.s_norm('t')}) AS nt FROM th),
    k AS (SELECT *, regexp_extract_all(lower(joined), {B.lit(C.APOSTROPHE_WORD)}) AS wd, {B.s_count('joined', C.DEVANAGARI)} AS dev,
        {B.s_count('joined', C.LATIN)} AS lat, CASE WHEN pair_id <> '' AND n % 4 = 0 THEN turns[-1] || '!' WHEN pair_id <> '' THEN turns[1] ELSE '' END AS pair_line,
        (CASE WHEN n % 7 = 0 THEN length + 1 ELSE length END) AS wanted FROM j),
    v AS (SELECT thread_id, label, script, CASE WHEN len(nt) <> wanted THEN 'bad_count' WHEN regexp_matches(joined, {B.lit(C.THREAD_REFUSAL)}) THEN 'refusal'
        WHEN len(list_filter(turns, lambda t: length(t) < 2 OR length(t) > 1500)) > 0 THEN 'turn_len'
        WHEN len(list_filter(range(1, len(nt)), lambda i: nt[i] = nt[i + 1])) > 0 THEN 'adjacent_dup'
        WHEN list_contains(nt[1:len(nt) - 1], nt[-1]) THEN 'last_in_context'
        WHEN pair_line <> '' AND trim(nt[-1], ' ."''!') <> trim({B.s_norm('pair_line')}, ' ."''!') THEN 'pair_line_changed'
        WHEN NOT ({_s_script()}) THEN 'script'
        WHEN label <> 'hostile_abuse' AND regexp_matches(joined, {B.lit(C.PROFANE_TERMS)}) THEN 'profanity_in_clean_class'
        WHEN label <> 'hostile_abuse' AND regexp_matches(joined, {B.lit(C.EXPLICIT_TERMS)}) THEN 'explicit'
        WHEN label = 'predatory_grooming' AND regexp_matches(joined, {B.lit(C.CONTACT_TERMS)}) THEN 'grooming_sexualised' ELSE 'ok' END AS reason FROM k)"""


def validated(spark, sf):
    th = B.threads(spark, sf)
    paired = F.col("pair_id") != ""
    line = (
        F.when(paired & (F.col("n") % 4 == 0), F.concat(F.element_at("turns", -1), F.lit("!")))
        .when(paired, F.get("turns", F.lit(0))).otherwise("")
    )
    wanted = F.when(F.col("n") % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))
    th = th.withColumns({"pair_line": line, "wanted": wanted})
    rules = G.thread_rules(F.col("wanted"), F.col("label"), F.col("script"), F.col("pair_line"), F.col("turns"), 2, 1500)
    return th.withColumn("reason", G.first_failure(rules))


@query("thread_validate", f"WITH {_VALID} SELECT thread_id, label, script, reason FROM v")
def thread_validate(spark, sf):
    return validated(spark, sf).select("thread_id", "label", "script", "reason")


@query(
    "thread_validate_basic",
    f"""WITH {B.THREADS}, j AS (SELECT thread_id, label, turns, turns[1:len(turns) - 1] AS ctx FROM th)
        SELECT thread_id, CASE WHEN regexp_matches(array_to_string(turns, ' '), {B.lit(C.THREAD_REFUSAL)}) THEN 'refusal'
        WHEN regexp_matches(array_to_string(turns, ' '), {B.lit(C.DEVANAGARI)}) THEN 'devanagari'
        WHEN len(list_filter(ctx, lambda t: length(t) < 2)) > 0 THEN 'empty'
        WHEN label = 'predatory_grooming' AND regexp_matches(array_to_string(ctx, ' '), {B.lit(C.CONTACT_TERMS)}) THEN 'grooming_sexual'
        WHEN label = 'benign' AND regexp_matches(array_to_string(turns, ' '), {B.lit(C.CONTACT_TERMS)}) THEN 'benign_sexual' ELSE 'ok' END AS reason FROM j""",
)
def thread_validate_basic(spark, sf):
    th = B.threads(spark, sf)
    return th.select("thread_id", G.first_failure(G.basic_thread_rules(F.col("label"), F.col("turns"))).alias("reason"))


_SURF = " OR ".join(f"contains(lower(t), {B.lit(s)})" for s in C.MARKER_SURFACES)


@query(
    "chat_validate",
    f"""WITH {B.THREADS}, s AS (SELECT thread_id, turns, CASE WHEN label_id % 2 = 0 THEN 'benign_chat' ELSE 'abuse_after_smalltalk' END AS kind,
          CASE n % 3 WHEN 0 THEN '  ' || turns[1] || '  ' WHEN 1 THEN turns[-1] ELSE 'fresh seed line ' || n END AS seed FROM th),
        p AS (SELECT *, {B.s_norm('seed')} AS sn, len(list_filter(turns, lambda t: {B.s_norm('t')} = {B.s_norm('seed')})) > 0 AS present FROM s),
        f AS (SELECT *, CASE WHEN kind = 'abuse_after_smalltalk' THEN list_append(list_filter(turns, lambda t: {B.s_norm('t')} <> sn), seed)
          WHEN present THEN list_transform(turns, lambda t: CASE WHEN {B.s_norm('t')} = sn THEN seed ELSE t END)
          WHEN len(turns) >= 2 THEN list_concat([turns[1], seed], turns[2:]) ELSE list_concat([seed], turns) END AS placed FROM p)
        SELECT thread_id, kind, len(placed)::BIGINT AS n_turns, md5(array_to_string(placed, chr(10))) AS placed_hash,
          CASE WHEN len(placed) < 3 THEN 'too_short' WHEN regexp_matches(array_to_string(placed, ' '), {B.lit(C.REFUSAL)}) THEN 'refusal'
          WHEN regexp_matches(array_to_string(placed, ' '), {B.lit(C.DEVANAGARI)}) THEN 'devanagari'
          WHEN len(list_filter(placed, lambda t: length(t) < 2)) > 0 THEN 'empty_turn'
          WHEN kind = 'benign_chat' AND len(list_filter(placed, lambda t: {B.s_norm('t')} = sn)) = 0 THEN 'seed_missing'
          WHEN kind = 'abuse_after_smalltalk' AND {B.s_norm('placed[-1]')} <> sn THEN 'seed_not_last'
          WHEN len(list_filter(placed, lambda t: {B.s_norm('t')} <> sn AND ({_SURF}))) > 0 THEN 'context_slur' ELSE 'ok' END AS reason FROM f""",
)
def chat_validate(spark, sf):
    th = B.threads(spark, sf)
    m = F.col("n") % 3
    th = th.withColumns(
        {
            "kind": F.when(F.col("label_id") % 2 == 0, "benign_chat").otherwise("abuse_after_smalltalk"),
            "seed": F.when(m == 0, F.concat(F.lit("  "), F.get("turns", F.lit(0)), F.lit("  "))).when(m == 1, F.element_at("turns", -1)).otherwise(
                F.concat(F.lit("fresh seed line "), F.col("n").cast("string"))
            ),
        }
    )
    turns, seed = F.col("turns"), F.col("seed")
    placed = F.when(F.col("kind") == "benign_chat", T.place_seed(turns, seed, False)).otherwise(T.place_seed(turns, seed, True))
    th = th.withColumn("placed", placed)
    return th.select(
        "thread_id", "kind", F.size("placed").cast("bigint").alias("n_turns"),
        F.md5(F.array_join("placed", "\n")).alias("placed_hash"),
        G.first_failure(G.chat_rules(F.col("kind"), seed, F.col("placed"))).alias("reason"),
    )


# --- replies -------------------------------------------------------------------------------
_LINE = "CASE i % 3 WHEN 1 THEN '- ' || turns[i] WHEN 2 THEN i || ') \"' || turns[i] || '\"' ELSE chr(10) || 'A: ' || turns[i] END"
_BULLET = r"^\s*(?:[-*]|\d+[.)]|[AB]:)\s*"


def _s_squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, {B.lit(C.SPACE_RUN)}, ' ', 'g'), ' ')"


@query(
    "json_extract_turns",
    f"""WITH {B.THREADS}, r AS (SELECT thread_id, conv_id % 4 AS k, turns,
            CASE conv_id % 4 WHEN 2 THEN array_to_string(list_transform(range(1, len(turns) + 1), lambda i: {_LINE}), chr(10)) ELSE '{{broken ' || array_to_string(turns, chr(10)) END AS raw FROM th),
        q AS (SELECT thread_id, list_filter(CASE WHEN k < 2 THEN list_transform(turns, lambda t: {_s_squeeze("t")})
            ELSE list_transform(regexp_split_to_array({B.s_strip("raw")}, '\r\n|\n|\r'), lambda t: {_s_squeeze(f"""trim({B.s_strip(f"regexp_replace(t, {B.lit(_BULLET)}, '')")}, '"')""")}) END, lambda t: t <> '') AS got FROM r)
        SELECT thread_id, CASE WHEN len(got) BETWEEN 3 AND 8 THEN len(got)::BIGINT END AS n_turns,
        CASE WHEN len(got) BETWEEN 3 AND 8 THEN md5(array_to_string(got, chr(10))) END AS turns_hash FROM q""",
)
def json_extract_turns(spark, sf):
    """Replies made of each thread's own turns: JSON in a sentence, messages, bullet lines, broken JSON over plain lines."""
    k = F.col("conv_id") % 4
    quoted = lambda t, i: F.concat((i + 1).cast("string"), F.lit(') "'), t, F.lit('"'))
    bullet = lambda t, i: F.when(i % 3 == 0, F.concat(F.lit("- "), t)).when(i % 3 == 1, quoted(t, i)).otherwise(F.concat(F.lit("\nA: "), t))
    raw = (
        F.when(k == 0, F.concat(F.lit("Sure: "), F.to_json(F.struct("turns")), F.lit(" done")))
        .when(k == 1, F.to_json(F.struct(F.col("turns").alias("messages"))))
        .when(k == 2, F.array_join(F.transform("turns", bullet), "\n"))
        .otherwise(F.concat(F.lit("{broken "), F.array_join("turns", "\n")))
    )
    d = B.threads(spark, sf).select("thread_id", raw.alias("raw")).withColumn("got", P.reply_turns(F.col("raw")))
    return d.select("thread_id", F.nullif(F.size("got"), F.lit(-1)).cast("bigint").alias("n_turns"), F.md5(F.array_join("got", "\n")).alias("turns_hash"))


@query(
    "verdict_parse",
    f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, length(text)::BIGINT AS n, coalesce(text, '') AS t FROM documents),
        a AS (SELECT doc_id, t, k, n, ['PRESERVED', 'softened', ' Unrelated ', 'maybe'][1 + coalesce(n, 0) % 4] AS w FROM d),
        r AS (SELECT doc_id, CASE k WHEN 0 THEN 'x ' || to_json({{'verdict': w, 'confidence': (n % 97)::VARCHAR || 'e-2', 'reason': t}})::VARCHAR || ' y'
            WHEN 1 THEN to_json({{'verdict': w, 'reason': t}})::VARCHAR WHEN 2 THEN '{{"verdict": ' || w || ' ' || t WHEN 3 THEN t || ' I think ' || w || '.'
            WHEN 4 THEN t ELSE to_json({{'label': n % 3, 'confidence': 0.9::DOUBLE, 'reason': t}})::VARCHAR END AS raw FROM a),
        o AS (SELECT doc_id, upper(raw) AS up, regexp_extract(raw, '(?s)\\{{.*\\}}') AS obj FROM r),
        j AS (SELECT doc_id, up, CASE WHEN json_valid(obj) THEN obj::JSON END AS js FROM o),
        v AS (SELECT doc_id, js, upper({B.s_strip("js->>'verdict'")}) AS named, CASE WHEN js->>'confidence' IS NULL THEN 0.5 ELSE TRY_CAST(js->>'confidence' AS DOUBLE) END AS conf,
            CASE WHEN up LIKE '%PRESERVED%' THEN 'PRESERVED' WHEN up LIKE '%SOFTENED%' THEN 'SOFTENED' WHEN up LIKE '%UNRELATED%' THEN 'UNRELATED' END AS word FROM j),
        f AS (SELECT *, coalesce(named IN ('PRESERVED', 'SOFTENED', 'UNRELATED') AND conf IS NOT NULL, false) AS ok, TRY_CAST(js->>'label' AS BIGINT) AS label FROM v)
       SELECT doc_id, CASE WHEN ok THEN named ELSE word END AS verdict, (CASE WHEN ok THEN conf WHEN word IS NOT NULL THEN 0.5 ELSE 0 END)::DOUBLE AS confidence,
       CASE WHEN label IN (0, 1) THEN label END AS judge_label, CASE WHEN label IN (0, 1) THEN md5(left(js->>'reason', 200)) END AS reason_hash FROM f""",
)
def verdict_parse(spark, sf):
    """Replies around each document's own text: JSON, no confidence, broken JSON, a sentence, no verdict, a label."""
    from parleyspark.session import table

    n, t, k = F.length("text").cast("bigint"), F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    word = F.get(F.array(*map(F.lit, ("PRESERVED", "softened", " Unrelated ", "maybe"))), (F.coalesce(n, F.lit(0)) % 4).cast("int"))
    share = F.concat((n % 97).cast("string"), F.lit("e-2"))
    raw = (
        F.when(k == 0, F.concat(F.lit("x "), F.to_json(F.struct(word.alias("verdict"), share.alias("confidence"), t.alias("reason"))), F.lit(" y")))
        .when(k == 1, F.to_json(F.struct(word.alias("verdict"), t.alias("reason"))))
        .when(k == 2, F.concat(F.lit('{"verdict": '), word, F.lit(" "), t))
        .when(k == 3, F.concat(t, F.lit(" I think "), word, F.lit(".")))
        .when(k == 4, t)
        .otherwise(F.to_json(F.struct((n % 3).alias("label"), F.lit(0.9).alias("confidence"), t.alias("reason"))))
    )
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw")).withColumns({"v": P.verdict(F.col("raw")), "j": P.judge(F.col("raw"))})
    return d.select("doc_id", "v.verdict", "v.confidence", F.col("j.label").cast("bigint").alias("judge_label"), F.md5("j.reason").alias("reason_hash"))
