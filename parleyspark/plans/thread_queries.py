"""Sampling and splits, threads, windows, incidents, ledger."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import text as T
from parleyspark.functions.hashing import contact_name, hash_unit, incident_id, split_name, stable_int, thread_hash
from parleyspark.operators import attention as A
from parleyspark.operators import dedup as D
from parleyspark.operators import gates as G
from parleyspark.operators import incidents as I
from parleyspark.operators import ledger as L
from parleyspark.operators import metrics as M
from parleyspark.operators import sampling as Sa
from parleyspark.operators import threads as Th
from parleyspark.operators import windows as Wi
from parleyspark.plans import frames as B
from parleyspark.plans.registry import query
from parleyspark.session import computed_once, cut_lineage, table


def order_hash(tag, key):
    return B.s_int(f"'{tag}|' || {key}")


# --- logs, splits, samples -----------------------------------------------------------------
@query(
    "last_wins_log",
    """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
)
def last_wins_log(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return D.last_wins(e, ["user_id", "event_type"], "event_id")


@query("hash_split", f"SELECT {B.s_split('doc_id')} AS split, lang, count(*) AS n FROM documents GROUP BY ALL")
def hash_split(spark, sf):
    d = table(spark, sf, "documents").select("lang", split_name(F.col("doc_id").cast("string")).alias("split"))
    return d.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_sample",
    f"""WITH {B.LABELLED}, s AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {order_hash('7', 'doc_id')}, doc_id) AS rn FROM lab)
        SELECT doc_id, label, row_number() OVER (ORDER BY {order_hash('shuffle', 'doc_id')}, doc_id) AS position FROM s WHERE rn <= 30""",
)
def stratified_sample(spark, sf):
    """n / 2 rows per label, then shuffled; the shuffle ranks a sample of fixed size."""
    d = Sa.sample_per_group(B.label_scores(spark, sf).select("doc_id", "label"), ["label"], "doc_id", 30, 7)
    w = W.orderBy(Sa.hash_order("shuffle", F.col("doc_id").cast("string")), "doc_id")
    return d.withColumn("position", F.row_number().over(w).cast("bigint"))


@query(
    "capped_sample",
    f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {order_hash('42', 'doc_id')}, doc_id) <= 20",
)
def capped_sample(spark, sf):
    return Sa.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 20, 42)


@query("audit_sample", f"SELECT doc_id FROM documents ORDER BY {order_hash('3', 'doc_id')}, doc_id LIMIT 150")
def audit_sample(spark, sf):
    return Sa.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 150, 3)


@query(
    "distinct_id_subset",
    f"""WITH i AS (SELECT DISTINCT conv_id FROM conversations ORDER BY {order_hash('7', 'conv_id')}, conv_id LIMIT 30)
        SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM i)""",
)
def distinct_id_subset(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    d = Sa.sample_ids(t, "conv_id", 30, 7)
    return d


@query(
    "train_val_permutation",
    f"""SELECT doc_id, CASE WHEN h < 0.8::DOUBLE THEN 'train' ELSE 'val' END AS part FROM (SELECT doc_id, {B.s_unit("'perm|' || doc_id")} AS h FROM documents)""",
)
def train_val_permutation(spark, sf):
    h = Sa.unit_interval("perm", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.when(h < 0.8, "train").otherwise("val").alias("part"))


SUBTYPES = (("tease", 3.0), ("joke", 2.0), ("roast", 4.0), ("banter", 1.0))


@query(
    "weighted_choice",
    f"""SELECT CASE WHEN u * 10.0 <= 3.0 THEN 'tease' WHEN u * 10.0 <= 5.0 THEN 'joke' WHEN u * 10.0 <= 9.0 THEN 'roast' ELSE 'banter' END AS subtype,
        count(*) AS n FROM (SELECT {B.s_unit("'pick|' || doc_id")} AS u FROM documents) GROUP BY 1""",
)
def weighted_choice(spark, sf):
    u = Sa.unit_interval("pick", F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents").select(Sa.weighted_choice(u, SUBTYPES).alias("subtype"))
    return d.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "length_seeds",
    f"""WITH {B.LABELLED}, s AS (SELECT doc_id, label, length(text) AS n_chars FROM lab WHERE length(text) BETWEEN 12 AND 1800)
        SELECT doc_id, label, n_chars FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY {order_hash('5', 'doc_id')}, doc_id) <= 40""",
)
def length_seeds(spark, sf):
    d = B.labelled(spark, sf).select("doc_id", "label", F.length("text").cast("bigint").alias("n_chars"))
    return Sa.sample_per_group(d.filter(F.col("n_chars").between(12, 1800)), ["label"], "doc_id", 40, 5)


_RANKED = f"""{B.LABELLED}, k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {order_hash('mix', 'doc_id')}, doc_id) - 1 AS rk FROM lab),
    be AS (SELECT doc_id, rk FROM k WHERE label = 1), ab AS (SELECT doc_id, rk FROM k WHERE label = 0), nb AS (SELECT count(*) AS n FROM be)"""


@query(
    "synthetic_windows",
    f"""WITH {_RANKED}
        SELECT 'benign_window' AS kind, rk // 3 AS example, (rk % 3)::BIGINT AS pos, doc_id FROM be, nb WHERE rk < n // 3 * 3
        UNION ALL SELECT 'camouflage', ab.rk, p.pos::BIGINT, be.doc_id FROM ab, nb, (SELECT unnest([0, 1]) AS pos) p JOIN be ON be.rk = (2 * ab.rk + p.pos) % n WHERE n >= 2
        UNION ALL SELECT 'camouflage', rk, 2, doc_id FROM ab, nb WHERE n >= 2""",
)
def synthetic_windows(spark, sf):
    """All benign rows in windows of three, and every abusive row behind two benign ones."""
    rows = B.label_scores(spark, sf).select("doc_id", "label")
    return Th.synthetic_windows(rows.filter("label = 1"), rows.filter("label = 0"), "doc_id", "mix")


# --- threads --------------------------------------------------------------------------------
@query(
    "thread_rollup",
    f"""WITH {B.THREADS}, c AS (SELECT *, array_to_string(turns[1:len(turns) - 1], ' [TURN] ') AS ctx, array_to_string(list_reverse(turns[1:len(turns) - 1]), ' [TURN] ') AS rev,
        list_transform(range(len(turns)), lambda i: CASE WHEN (len(turns) - 1 - i) % 2 = 0 THEN 'X' ELSE 'Y' END) AS sp FROM th)
        SELECT thread_id, length, length - 1 AS n_context, script, label, pair_id, split, md5(CASE WHEN ctx <> '' THEN ctx || ' [LAST] ' || turns[-1] ELSE '[LAST] ' || turns[-1] END) AS packed,
        md5(rev) AS reversed, array_to_string(sp, '') AS speakers, md5(array_to_string(list_transform(turns, lambda t: {B.s_norm('t')}), chr(10))) AS thread_hash FROM c""",
)
def thread_rollup(spark, sf):
    th = B.threads(spark, sf)
    turns = F.col("turns")
    return th.select(
        "thread_id", "length", (F.col("length") - 1).alias("n_context"), "script", "label", "pair_id", "split",
        F.md5(T.pack_thread(turns)).alias("packed"), F.md5(T.reversed_context(turns)).alias("reversed"),
        F.array_join(T.alternate_speakers(F.col("length"), F.lit("X"), F.lit("Y")), "").alias("speakers"),
        thread_hash(turns).alias("thread_hash"),
    )


@query(
    "thread_hash_dedup",
    f"""WITH {B.THREADS}, h AS (SELECT thread_id, md5(array_to_string(list_transform(turns, lambda t: {B.s_norm('t')}), chr(10))) AS hash FROM th)
        SELECT thread_id, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY thread_id) = 1""",
)
def thread_hash_dedup(spark, sf):
    h = B.threads(spark, sf).select("thread_id", thread_hash(F.col("turns")).alias("hash"))
    return D.first_wins(h, ["hash"], ["thread_id"])


@query(
    "manifest_cube",
    f"WITH {B.THREADS} SELECT length, script, label, split, count(*) AS count, count(*) FILTER (pair_id <> '') AS paired FROM th GROUP BY ALL",
)
def manifest_cube(spark, sf):
    return B.threads(spark, sf).groupBy("length", "script", "label", "split").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("pair_id") != "").alias("paired")
    )


@query(
    "multi_marginals",
    f"""WITH {B.THREADS}, s AS (SELECT split, length::VARCHAR AS length, script, label, subtype FROM th)
        SELECT 'split' AS grouping, split AS value, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'length', length, count(*) FROM s GROUP BY length
        UNION ALL SELECT 'script', script, count(*) FROM s GROUP BY script UNION ALL SELECT 'label', label, count(*) FROM s GROUP BY label
        UNION ALL SELECT 'subtype', subtype, count(*) FROM s GROUP BY subtype
        UNION ALL SELECT 'length+script+label', length || '|' || script || '|' || label, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM s""",
)
def multi_marginals(spark, sf):
    fields = ["split", "length", "script", "label", "subtype"]
    return Th.marginals(B.threads(spark, sf), fields, ["length", "script", "label"])


@query(
    "cell_quota_topn",
    f"WITH {B.THREADS} SELECT script, length, label, thread_id, n FROM th QUALIFY row_number() OVER (PARTITION BY script, length, label ORDER BY n, thread_id) <= 3",
)
def cell_quota_topn(spark, sf):
    th = B.threads(spark, sf).select("script", "length", "label", "thread_id", "n")
    return Sa.top_per_group(th, ["script", "length", "label"], ["n", "thread_id"], 3)


_CELLS = f"""{B.THREADS}, grid AS (SELECT s.script, l.length, c.label FROM (SELECT unnest(['english', 'hinglish', 'hindi_devanagari']) AS script) s,
    (SELECT DISTINCT length FROM th) l, (SELECT unnest({B.words(C.THREAD_CLASSES)}) AS label) c),
    hv AS (SELECT script, length, label, count(*) FILTER (label_id <> 3) AS accepted, max(n) AS top_n FROM th GROUP BY ALL),
    df AS (SELECT grid.*, coalesce(accepted, 0) AS accepted, 10 - coalesce(accepted, 0) AS deficit, coalesce(top_n, -1) + 1 AS start FROM grid LEFT JOIN hv USING (script, length, label)),
    nd AS (SELECT *, (ceil(deficit::DOUBLE * 1.1::DOUBLE) + 2)::BIGINT AS need FROM df WHERE deficit > 0)"""


def deficits(spark, sf):
    th = B.threads(spark, sf)
    labels = F.explode(F.array(*[F.lit(c) for c in C.THREAD_CLASSES])).alias("label")
    scripts = F.explode(F.array(*[F.lit(s) for s in ("english", "hinglish", "hindi_devanagari")])).alias("script")
    grid = th.select("length").distinct().select("length", labels).select("length", "label", scripts)
    return Th.cell_deficits(th, grid, ["script", "length", "label"], "n", F.col("label_id") != 3, 10, 0.1)


@query("cell_deficit", f"WITH {_CELLS} SELECT script, length, label, accepted, deficit, need, start FROM nd")
def cell_deficit(spark, sf):
    return deficits(spark, sf)


@query(
    "new_specs",
    f"""WITH {_CELLS} SELECT script, length, label, n, script || ':' || length || ':' || label || ':' || lpad(n::VARCHAR, 6, '0') AS key
        FROM (SELECT *, unnest(range(start, start + need)) AS n FROM nd)""",
)
def new_specs(spark, sf):
    return Th.new_specs(deficits(spark, sf), ["script", "length", "label"])


def comment_tree(spark, sf):
    """Conversation turns as a reply tree: turn 0 is the post, turn t answers turn (t - 1) / 2."""
    t = B.turns(spark, sf)
    name = lambda i: F.concat_ws("#", F.col("conv_id").cast("string"), i.cast("string"))
    up = F.floor((F.col("turn") - 1) / 2)
    comments = t.filter("turn > 0").select(name(F.col("turn")).alias("id"), name(up).alias("parent"), T.scrub(F.col("text")).alias("text"), "role")
    posts = t.filter("turn = 0").select(name(F.col("turn")).alias("id"), T.scrub(F.col("text")).alias("text"))
    return comments, posts


_SC = f"trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '[linebreak]', ' '), '<span[^>]*>.*?</span>', ' ', 'g'), 'https?://[^\\s\\p{{Z}}]+', ' ', 'g'), {B.lit(C.SPACE_RUN)}, ' ', 'g'), ' ')"


@query(
    "ancestor_chain",
    f"""WITH RECURSIVE nd AS (SELECT conv_id, turn, conv_id || '#' || turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up, {_SC} AS t FROM conversations),
        walk AS (SELECT id, conv_id, up AS cur, 1 AS hop FROM nd WHERE turn > 0 UNION ALL
            SELECT w.id, w.conv_id, n.up, w.hop + 1 FROM walk w JOIN nd n ON n.conv_id = w.conv_id AND n.turn = w.cur WHERE n.up IS NOT NULL AND w.hop < 9),
        tx AS (SELECT w.id, w.hop, CASE WHEN n.t = '' THEN '[empty]' ELSE n.t END AS t FROM walk w JOIN nd n ON n.conv_id = w.conv_id AND n.turn = w.cur),
        allt AS (SELECT * FROM tx UNION ALL SELECT id, 0, t FROM nd WHERE turn > 0)
        SELECT id, (count(*) - 1)::BIGINT AS n_ctx, md5(string_agg(left(t, 900), chr(10) ORDER BY hop DESC)) AS turns_hash FROM allt GROUP BY id""",
)
def ancestor_chain(spark, sf):
    comments, posts = comment_tree(spark, sf)
    out = Th.assemble_chains(comments, posts)
    return out.select("id", (F.size("turns") - 1).cast("bigint").alias("n_ctx"), F.md5(F.array_join("turns", "\n")).alias("turns_hash"))


@query(
    "context_slices",
    """WITH RECURSIVE nd AS (SELECT conv_id, turn, role, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up FROM conversations),
        walk AS (SELECT conv_id, turn, role, up AS cur, 1 AS hop FROM nd WHERE turn > 0 UNION ALL
            SELECT w.conv_id, w.turn, w.role, n.up, w.hop + 1 FROM walk w JOIN nd n ON n.conv_id = w.conv_id AND n.turn = w.cur WHERE n.up IS NOT NULL AND w.hop < 9),
        d AS (SELECT conv_id, turn, any_value(role) AS role, max(hop) AS n_ctx FROM walk GROUP BY ALL),
        s AS (SELECT unnest(list_filter(['has_parent_context', CASE WHEN n_ctx = 1 THEN 'ctx_1' END, CASE WHEN n_ctx BETWEEN 2 AND 3 THEN 'ctx_2_3' END,
            CASE WHEN n_ctx >= 4 THEN 'ctx_4_plus' END, CASE WHEN role = 'user' THEN 'from_user' END], lambda x: x IS NOT NULL)) AS slice FROM d)
        SELECT slice, count(*) AS n FROM s GROUP BY slice""",
)
def context_slices(spark, sf):
    comments, _ = comment_tree(spark, sf)
    chains = Th.ancestor_chains(comments.select("id", "parent"), 9).withColumn("n_ctx", F.size("chain"))
    d = chains.join(comments.select("id", "role"), "id")
    n = F.col("n_ctx")
    names = F.array(
        F.when(n >= 1, "has_parent_context"), F.when(n == 1, "ctx_1"), F.when(n.between(2, 3), "ctx_2_3"),
        F.when(n >= 4, "ctx_4_plus"), F.when(F.col("role") == "user", "from_user"),
    )
    return d.select(F.explode(F.array_compact(names)).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_both_correct",
    f"""WITH {B.THREADS}, p AS (SELECT *, CASE WHEN {B.s_int("'thread|' || thread_id")} % 10 < 7 THEN label_id ELSE ({B.s_int("'thread2|' || thread_id")} % 10) % 5 END AS pred FROM th WHERE pair_id <> ''),
        l AS (SELECT pair_id, arg_max(pred, thread_id) FILTER (label = 'friendly_sarcasm') AS s, arg_max(pred, thread_id) FILTER (label = 'hostile_abuse') AS a FROM p GROUP BY pair_id)
        SELECT count(*) AS n_pairs, CASE WHEN count(*) > 0 THEN count(*) FILTER (s = 1 AND a = 2)::DOUBLE / count(*)::DOUBLE ELSE 0.0::DOUBLE END AS both_correct FROM l WHERE s IS NOT NULL AND a IS NOT NULL""",
)
def pair_both_correct(spark, sf):
    from parleyspark.plans.metric_queries import thread_predictions

    d = thread_predictions(spark, sf).filter("pair_id <> ''")
    pairs = Th.conditional_pair(d, "pair_id", "label", "thread", "thread_id", ["friendly_sarcasm", "hostile_abuse"])
    hit = F.count_if((F.col("friendly_sarcasm") == 1) & (F.col("hostile_abuse") == 2))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), M.ratio(hit, F.count(F.lit(1))).alias("both_correct"))


@query(
    "variant_pairing",
    f"""WITH {B.REPLIES}, c AS (SELECT doc_id, label, source, attempt, {B.s_clean('raw')} AS reply FROM rep WHERE attempt < 2),
        w AS (SELECT doc_id, max(reply) FILTER (attempt = 0) AS preserved, max(reply) FILTER (attempt = 1) AS softened FROM c GROUP BY doc_id),
        k AS (SELECT *, CASE WHEN preserved = '' OR softened = '' THEN 'empty' WHEN regexp_matches(lower(softened), '{'|'.join(s.stem for s in C.MARKERS)}') THEN 'softened_still_marked' ELSE 'usable' END AS status FROM w)
        SELECT status, count(*) AS n, sum(length(preserved))::BIGINT AS preserved_chars FROM k GROUP BY status""",
)
def variant_pairing(spark, sf):
    """Both arms of a source in one row; unusable sources are named, not hidden."""
    r = B.replies(spark, sf).filter("attempt < 2").select(
        "doc_id", "attempt", F.when(F.col("attempt") == 0, "preserved").otherwise("softened").alias("arm"), T.clean_reply(F.col("raw")).alias("reply")
    )
    both = Th.conditional_pair(r, "doc_id", "arm", "reply", "attempt", ["preserved", "softened"])
    marked = F.lower("softened").rlike("|".join(m.stem for m in C.MARKERS))
    empty = (F.col("preserved") == "") | (F.col("softened") == "")
    status = G.first_failure([("empty", empty), ("softened_still_marked", marked)], "usable")
    return both.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("preserved")).alias("preserved_chars")
    )


@query(
    "composite_keys",
    """SELECT o_orderkey, 'item-' || o_orderkey || '-' || o_orderstatus AS key, o_orderkey AS parsed, 'item-' || o_orderkey || '|' || lpad((o_custkey % 1000)::VARCHAR, 6, '0') AS arm FROM orders""",
)
def composite_keys(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.format_string("item-%d-%s", "o_orderkey", "o_orderstatus")
    return o.select(
        "o_orderkey", key.alias("key"), F.split_part(key, F.lit("-"), F.lit(2)).try_cast("bigint").alias("parsed"),
        F.format_string("item-%d|%06d", F.col("o_orderkey"), F.col("o_custkey") % 1000).alias("arm"),
    )


@query(
    "viewer_page",
    f"""WITH {B.THREADS} SELECT thread_id, length, script, label, split FROM th WHERE script = 'english' AND contains(lower(array_to_string(turns, ' ')), 'the')
        ORDER BY thread_id LIMIT 10 OFFSET 5""",
)
def viewer_page(spark, sf):
    cond = Th.row_filter({"script": "english", "label": None}, text="the")
    th = B.threads(spark, sf)
    hits = th.filter(cond).orderBy("thread_id").offset(5).limit(10)
    return hits.select("thread_id", "length", "script", "label", "split")


@query(
    "viewer_sample",
    f"""WITH {B.THREADS}, p AS (SELECT *, count(*) OVER () AS total FROM th WHERE split = 'train') SELECT thread_id, total FROM p ORDER BY {order_hash('1', 'thread_id')}, thread_id LIMIT 10""",
)
def viewer_sample(spark, sf):
    pool = B.threads(spark, sf).filter(Th.row_filter({"split": "train"})).select("thread_id")
    total = pool.agg(F.count(F.lit(1))).scalar()
    return Sa.sample(pool, "thread_id", 10, 1).withColumn("total", total)


# --- windows ----------------------------------------------------------------------------------
def messages(spark, sf):
    return B.turns(spark, sf).withColumn("tokens", T.content_token_count(F.col("text")))


def _s_window(max_tokens: int, short: int, source: str = "conversations") -> str:
    return f"""tk AS (SELECT conv_id, turn, role, text, ({B.s_content_count('text')})::BIGINT AS tokens FROM {source}),
        lg AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM tk),
        ps AS (SELECT *, before IS NULL OR text <> before AS push FROM lg),
        pn AS (SELECT *, sum(push::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM ps),
        sl AS (SELECT a.conv_id, a.turn, a.role, a.text AS cur, a.tokens AS current_tokens, a.no AS cur_no, b.no, b.text, b.tokens,
            sum(b.tokens) OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.no DESC) AS suffix FROM pn a JOIN pn b ON a.conv_id = b.conv_id AND b.push AND b.no BETWEEN a.no - 7 AND a.no),
        wn AS (SELECT conv_id, turn, any_value(role) AS role, any_value(cur) AS text, any_value(current_tokens) AS current_tokens, count(*) AS slots, sum(tokens)::BIGINT AS window_tokens,
            string_agg(text, ' ' ORDER BY no) AS window_text, count(*) > 1 AND any_value(current_tokens) < {short} AS use_window FROM sl
            WHERE suffix <= {max_tokens} OR no = cur_no GROUP BY conv_id, turn)"""


def windows(spark, sf, max_tokens=C.MAX_WINDOW_TOKENS, short=C.SHORT_TOKENS, rows=None):
    rows = messages(spark, sf) if rows is None else rows
    d = Wi.rolling_window(rows, "conv_id", "turn", "text", "tokens", max_tokens=max_tokens, short_tokens=short)
    return d.withColumn("window_text", Wi.window_text(F.col("slots"), "text"))


def _window_columns(d):
    return d.select(
        "conv_id", "turn", F.col("tokens").alias("current_tokens"), F.col("n_slots").alias("slots"), "window_tokens", "use_window",
        F.md5("window_text").alias("window_hash"),
    )


_WCOLS = "SELECT conv_id, turn, current_tokens, slots, window_tokens, use_window, md5(window_text) AS window_hash FROM wn"


@query("rolling_window", f"WITH {_s_window(96, 8)} {_WCOLS}")
def rolling_window(spark, sf):
    return _window_columns(windows(spark, sf))


@query("rolling_window_wide", f"WITH {_s_window(1000, 60)} {_WCOLS}")
def rolling_window_wide(spark, sf):
    return _window_columns(windows(spark, sf, 1000, 60))


_SCORE = lambda tag, text: B.s_unit(f"'{tag}|' || {text}")
_FUSION = f"""ms AS (SELECT conv_id % 4 AS kind_id, conv_id, turn, role, text, slots, use_window, {_SCORE('m', 'text')} AS current, {_SCORE('m', 'window_text')} AS win, {_SCORE('kv', 'text')} AS kv FROM wn),
    fu AS (SELECT *, ({B.s_int("'fail|' || text")} % 20) = 0 AS failed FROM ms),
    sc AS (SELECT *, CASE WHEN failed THEN kv WHEN use_window THEN greatest(current, win) ELSE current END AS score FROM fu),
    fl AS (SELECT *, CASE WHEN failed THEN score >= 0.6::DOUBLE ELSE score > 0.5 END AS flagged FROM sc)"""
_FUSED = f"{_s_window(1000, 60)}, {_FUSION}"


def fused(spark, sf, rows=None):
    """Window-fused scores with a fallback where the stand-in scorer fails."""
    d = windows(spark, sf, 1000, 60, rows)
    d = d.withColumns(
        {
            "current": hash_unit(F.lit("m"), F.col("text")),
            "win": hash_unit(F.lit("m"), F.col("window_text")),
            "kv": hash_unit(F.lit("kv"), F.col("text")),
            "failed": stable_int(F.lit("fail"), F.col("text")) % 20 == 0,
        }
    )
    current = F.when(~F.col("failed"), F.col("current"))
    d = d.withColumn("score", Wi.fused_score(current, F.when(~F.col("failed"), F.col("win")), F.col("use_window"), F.col("kv")))
    return d.withColumn("flagged", G.flagged(F.col("score"), F.col("failed"), 0.6))


@query(
    "gated_fusion",
    f"WITH {_FUSED} SELECT conv_id, turn, score, flagged, CASE WHEN failed THEN 'kv-fallback' WHEN use_window THEN 'rolling-window' ELSE 'current' END AS mode, "
    "CASE WHEN flagged THEN CASE WHEN score >= 0.9::DOUBLE THEN 'high' ELSE 'medium' END END AS severity FROM fl",
)
def gated_fusion(spark, sf):
    d = fused(spark, sf)
    mode = F.when(F.col("failed"), "kv-fallback").when(F.col("use_window"), "rolling-window").otherwise("current")
    return d.select("conv_id", "turn", "score", "flagged", mode.alias("mode"), G.severity(F.col("flagged"), F.col("score")).alias("severity"))


@query(
    "window_coverage",
    f"WITH {_FUSED} SELECT kind_id, count(*) AS n, count(*) FILTER (use_window) AS used, count(*) FILTER (use_window)::DOUBLE / count(*)::DOUBLE AS coverage FROM fl GROUP BY kind_id",
)
def window_coverage(spark, sf):
    d = windows(spark, sf, 1000, 60)
    used = F.count_if("use_window")
    return d.groupBy((F.col("conv_id") % 4).alias("kind_id")).agg(
        F.count(F.lit(1)).alias("n"), used.alias("used"), M.ratio(used, F.count(F.lit(1))).alias("coverage")
    )


@query(
    "contact_eviction",
    """WITH e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
        d AS (SELECT e.event_id, e.user_id, e.prev, (SELECT count(DISTINCT o.user_id) FROM events o WHERE o.event_id > e.prev AND o.event_id < e.event_id) AS between_users FROM e)
        SELECT user_id, count(*) AS n_messages, count(*) FILTER (prev IS NOT NULL AND between_users < 24) AS kept FROM d GROUP BY user_id""",
)
def contact_eviction(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    h = Wi.contact_history(e, "user_id", "event_id", block_rows=4096)
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if("kept_history").alias("kept"))


# --- live scoring and incidents -------------------------------------------------------------
_SUPPRESSED = "conv_id % 17 = 0"
_LIVE = f"""inc AS (SELECT * FROM conversations WHERE role <> 'system' AND length({B.s_strip('text')}) >= 5 AND NOT ({_SUPPRESSED})
        QUALIFY row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) = 1), {_s_window(1000, 60, 'inc')}, {_FUSION},
    hit AS (SELECT conv_id, turn, text, score, CASE WHEN score >= 0.9::DOUBLE THEN 'high' ELSE 'medium' END AS severity, conv_id * 1000 + turn AS seq,
        sha256(conv_id || chr(10) || lower({B.s_strip('text')})) AS id FROM fl WHERE flagged)"""


def live_hits(spark, sf):
    """The live path in batch form: filter, suppress, first delivery, window, score, flag."""
    suppressed = table(spark, sf, "conversations").filter(_SUPPRESSED).select("conv_id").distinct()
    rows = messages(spark, sf).filter(G.incoming(F.col("role") == "system", F.col("text")))
    rows = D.seen_once(rows.join(suppressed, "conv_id", "left_anti"), ["conv_id", "text"], "turn")
    d = fused(spark, sf, rows).filter("flagged")
    contact = F.col("conv_id").cast("string")
    return d.select(
        "conv_id", "turn", "text", "score", G.severity(F.col("flagged"), F.col("score")).alias("severity"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), incident_id(contact, F.col("text")).alias("id"),
    )


@query("live_scoring", f"WITH {_LIVE} SELECT id, conv_id, turn, score, severity FROM hit")
def live_scoring(spark, sf):
    return live_hits(spark, sf).select("id", "conv_id", "turn", "score", "severity")


_LOG = f"""WITH RECURSIVE {_LIVE}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM hit),
    st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS log, []::BIGINT[] AS seqs UNION ALL
        SELECT o.i, CASE WHEN list_contains(st.log, o.id) THEN st.log ELSE list_slice(list_concat([o.id], st.log), 1, 100) END,
        CASE WHEN list_contains(st.log, o.id) THEN st.seqs ELSE list_slice(list_concat([o.seq], st.seqs), 1, 100) END FROM st JOIN o ON o.i = st.i + 1),
    fin AS (SELECT unnest(seqs) AS seq FROM (SELECT seqs FROM st ORDER BY i DESC LIMIT 1)), kept_log AS (SELECT hit.* FROM hit JOIN fin ON hit.seq = fin.seq)"""


def incident_rows(spark, sf):
    return I.incident_log(live_hits(spark, sf), "seq", cap=100)


@query("incident_log", f"{_LOG} SELECT id, conv_id::VARCHAR AS contact, score, severity, seq FROM kept_log")
def incident_log(spark, sf):
    log = incident_rows(spark, sf)
    return log.select("id", contact_name(F.col("conv_id").cast("string"), "Unknown chat").alias("contact"), "score", "severity", "seq")


@query("incident_counters", f"{_LOG} SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high FROM kept_log")
def incident_counters(spark, sf):
    return I.counters(incident_rows(spark, sf))


@query(
    "seen_dedup",
    """SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS deliveries FROM events GROUP BY user_id, event_type""",
)
def seen_dedup(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("deliveries"))


ABUSE_STEMS = ("clown", "trash", "loser", "worthless", "pathetic", "tion", "enth", "ment", "heit", "ouea", "keit", "chen")
BENIGN_STEMS = ("the", "and", "que", "der", "thes", "eaux")


def weights():
    return A.placeholder_weights(ABUSE_STEMS, BENIGN_STEMS)


@query("attention_scores")
def attention_scores(spark, sf):
    """Attention over the kept slots. Features stay in the JVM; only the small
    matrix products run in Arrow batches."""
    d = A.with_features(messages(spark, sf), "text", ABUSE_STEMS, BENIGN_STEMS)
    d = Wi.rolling_window(d, "conv_id", "turn", "text", "tokens", payload=["feats"], max_tokens=1000)
    scored = d.withColumn("a", A.attention_udf(weights())(F.transform("slots", lambda s: s["feats"])))
    return scored.select("conv_id", "turn", "n_slots", F.col("a.score").alias("score"), F.col("a.attn_last").alias("attn_last"), "m_index", "i_index")


@query("logistic_fit")
def logistic_fit(spark, sf):
    """Class-balanced logistic baseline on standardised features."""
    d = A.with_features(B.labelled(spark, sf), "text", ABUSE_STEMS, BENIGN_STEMS)
    d = cut_lineage(d.select("doc_id", "label", "feats"))
    n = len(A.BASE_FEATURES) + len(ABUSE_STEMS) + len(BENIGN_STEMS)
    z = A.standardisation(d, "feats", n)
    mean, std = z.select("mean").scalar(), z.select("std").scalar()
    rows = d.select("doc_id", "label", F.col("feats"), mean.alias("_m"), std.alias("_s"))
    scaled = F.zip_with(F.zip_with("feats", "_m", lambda x, m: x - m), "_s", lambda x, s: x / F.greatest(s, F.lit(1e-6)))
    rows = rows.select("doc_id", (1 - F.col("label")).alias("y"), scaled.alias("x"))
    w, b = A.fit_logistic(rows, "x", "y", n, epochs=40)
    return rows.select("doc_id", "y", A.logistic_score(F.col("x"), w, b).alias("score"))


@query("attention_training")
def attention_training(spark, sf):
    """Split texts as four-slot examples: train the attention, then score them."""
    from parleyspark.operators.training import train_attention

    # a filter on the pieces would be pushed into the scan and tokenise there once for every use of the tokens
    d = computed_once(B.labelled(spark, sf).select("doc_id", "label", "text"), toks=T.tokens(F.col("text")))
    pieces = d.select("doc_id", (1 - F.col("label")).alias("y"), F.posexplode(T.four_way_split(F.col("toks"))).alias("pos", "text"))
    feats = A.with_features(pieces, "text", ABUSE_STEMS, BENIGN_STEMS)
    slots = feats.groupBy("doc_id", "y").agg(F.sort_array(F.collect_list(F.struct("pos", "feats"))).alias("_s"))
    rows = cut_lineage(slots.select("doc_id", "y", F.col("_s.feats").alias("slots")))
    w, _ = train_attention(rows, "doc_id", "slots", "y", weights(), epochs=6)
    return rows.select("doc_id", "y", A.attention_udf(w)(F.col("slots"))["score"].alias("score"))


# --- ledger ------------------------------------------------------------------------------------
def calls(spark, sf):
    """Line items as metered calls: quantity and price stand for token counts."""
    li = table(spark, sf, "lineitem")
    models = F.array(*[F.lit(m) for m in ("qwen.qwen3-32b", "meta.llama3-8b-instruct-v1:0", "local", "other")])
    d = li.select(
        F.col("l_shipdate").alias("ts_utc"), F.col("l_returnflag").alias("job"), F.col("l_linestatus").alias("service"),
        F.get(models, F.col("l_linenumber") % 4).alias("model"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_extendedprice").cast("bigint").alias("output_tokens"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call_id"), "l_partkey",
    )
    usd = L.token_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return d.withColumn("usd_estimated", usd)


_CALLS = """cl AS (SELECT l_shipdate AS ts_utc, l_returnflag AS job, l_linestatus AS service, (['qwen.qwen3-32b', 'meta.llama3-8b-instruct-v1:0', 'local', 'other'])[l_linenumber % 4 + 1] AS model,
    trunc(l_quantity)::BIGINT AS i, trunc(l_extendedprice)::BIGINT AS o, l_orderkey * 8 + l_linenumber AS call_id, l_partkey FROM lineitem),
    us AS (SELECT *, (i::DOUBLE * (CASE model WHEN 'meta.llama3-8b-instruct-v1:0' THEN 0.30 WHEN 'local' THEN 0.0 ELSE 0.15 END)::DOUBLE
        + o::DOUBLE * (CASE model WHEN 'local' THEN 0.0 ELSE 0.60 END)::DOUBLE) / 1000000.0::DOUBLE AS usd FROM cl)"""


@query(
    "ledger_rollup",
    f"""WITH {_CALLS} SELECT ts_utc::DATE AS date_utc, job, service, model, count(*) AS n_calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(usd), 8) AS usd_estimated
        FROM us GROUP BY GROUPING SETS ((ts_utc::DATE, job, service, model), ())""",
)
def ledger_rollup(spark, sf):
    return L.ledger(calls(spark, sf)).withColumn("usd_estimated", F.round("usd_estimated", 8))


@query(
    "spend_cap",
    f"""WITH {_CALLS}, r AS (SELECT *, coalesce(sum(usd) OVER (ORDER BY ts_utc::DATE, call_id, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent FROM us)
        SELECT ts_utc::DATE AS day, count(*) AS n_calls, round(max(spent), 4) AS spent_before FROM r WHERE spent < 40.0 GROUP BY 1""",
)
def spend_cap(spark, sf):
    c = calls(spark, sf).select(
        F.to_date("ts_utc").alias("day"), F.floor(F.col("call_id") / 65536).alias("stretch"), "call_id", "l_partkey",
        F.col("usd_estimated").alias("usd"),
    )
    kept = I.running_spend(c, "day", ["stretch"], ["call_id", "l_partkey"], "usd", 40.0)
    return kept.groupBy("day").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.max("spent_before"), 4).alias("spent_before"))


@query(
    "compute_cost",
    """WITH s AS (SELECT user_id, greatest((epoch_us(max(ts))::DOUBLE - epoch_us(min(ts))::DOUBLE) / 1e6::DOUBLE, 60.0::DOUBLE) / 3600.0::DOUBLE AS hours FROM events GROUP BY user_id)
        SELECT user_id, hours, round(0.526::DOUBLE * hours, 9) AS compute_usd, round(0.08::DOUBLE * 100.0::DOUBLE * hours / 730.0::DOUBLE, 9) AS disk_usd, round(2.5::DOUBLE * 0.023::DOUBLE * (hours / 730.0::DOUBLE), 9) AS store_usd FROM s""",
)
def compute_cost(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("launch"), F.max("ts").alias("end"))
    s = s.select("user_id", L.billed_hours(F.col("launch"), F.col("end")).alias("hours"))
    cost = L.compute_cost(F.col("hours"), F.lit(0.526), F.lit(100.0), F.lit(0.08), F.lit(2.5))
    return s.select("user_id", "hours", *[F.round(c, 9).alias(n) for n, c in cost.items()])


TARGETS = {"train": 500, "val": 60, "test": 60}


@query(
    "progress_report",
    f"""WITH {B.RESOLVED}, t AS (SELECT unnest(['train', 'val', 'test']) AS split, unnest([500, 60, 60]) AS target), o AS (SELECT split, count(*) AS done FROM outcome GROUP BY split)
        SELECT split, target::BIGINT AS target, coalesce(done, 0) AS done, 100.0::DOUBLE * coalesce(done, 0)::DOUBLE / target::DOUBLE AS percent FROM t LEFT JOIN o USING (split)""",
)
def progress_report(spark, sf):
    done = G.resolve_attempts(B.replies(spark, sf), ["doc_id", "split"]).groupBy("split").agg(F.count(F.lit(1)).alias("done"))
    pairs = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(n).cast("bigint").alias("target")) for s, n in TARGETS.items()])
    t = spark.range(1).select(F.inline(pairs)).join(done, "split", "left")
    d = F.coalesce("done", F.lit(0))
    return t.select("split", "target", d.cast("bigint").alias("done"), (F.lit(100.0) * d.cast("double") / F.col("target").cast("double")).alias("percent"))
