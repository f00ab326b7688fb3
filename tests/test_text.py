import math
import pytest
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import replies as P
from parleyspark.functions import similarity as S
from parleyspark.functions import text as T
from parleyspark.functions.hashing import incident_id, paired_split_name, stable_int


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_tokens_of_mixed_scripts(spark):
    got = one(spark, T.tokens(F.col("t")), t="Don't जाना १२ 42 ok!! 👍🏽 café")
    assert got[:5] == ["Don't", "जाना", "१२", "42", "ok"] or got[:2] == ["Don't", "जाना"]
    assert got.count("!") == 2 and "42" in got


@pytest.mark.parametrize(
    "token,free",
    [("42", True), ("?", True), ("NASA", True), ("ABCDEF", False), ("A", False), ("https", True), ("word", False), ("😀", True)],
)
def test_language_free(spark, token, free):
    assert one(spark, T.is_language_free(F.col("t")), t=token) is free


@pytest.mark.parametrize(
    "text,cmi,m,i,switches",
    [("le the", 50.0, 1.0, 1.0, 1), ("the and", 0.0, 0.0, 0.0, 0), ("le the le", 100 * (1 - 2 / 3), None, 1.0, 2), ("42 !", 0.0, 0.0, 0.0, 0)],
)
def test_mixing_indices(spark, text, cmi, m, i, switches):
    row = T.with_mixing(spark.createDataFrame([(text,)], ["text"])).first()
    assert row["cmi"] == pytest.approx(cmi) and row["i_index"] == i and row["switches"] == switches
    if m is not None:
        assert row["m_index"] == pytest.approx(m)


@pytest.mark.parametrize("n,sizes", [(8, [2, 2, 2, 2]), (10, [3, 3, 2, 2]), (7, None)])
def test_four_way_split(spark, n, sizes):
    got = one(spark, T.four_way_split(T.tokens(F.col("t"))), t=" ".join(["word"] * n))
    assert (got is None) if sizes is None else [len(p.split()) for p in got] == sizes


def test_stem_rule(spark):
    pad = lambda t: T.padded_content(F.lit(t))
    assert one(spark, T.stem_hit(pad("clowns here"), "clown"))
    assert not one(spark, T.stem_hit(pad("clownish here"), "clown"))
    assert not one(spark, T.stem_hit(pad("cats"), "cat"))


def test_marker_positions_see_through_obfuscation(spark):
    got = one(spark, T.marker_positions(F.col("t"), C.MARKER_SURFACES), t="you cl.own and l0-ser! trashy, xtrash")
    assert got == [1, 3, 4]


def test_clean_reply(spark):
    assert one(spark, T.clean_reply(F.col("t")), t='  Hinglish: Output:\n\n "hello there" \nnext') == "hello there"
    assert one(spark, T.clean_reply(F.col("t")), t="   ") == ""


def test_scrub_and_roles(spark):
    assert one(spark, T.scrub(F.col("t")), t="a[linebreak]b <span x>gone</span> http://x.y/z  c") == "a b c"
    assert one(spark, T.strip_role(F.col("t")), t="Speaker 2: hi") == "hi"
    assert one(spark, T.strip_name(F.col("t"), F.lit("Asha")), t="asha: hi") == "hi"


def test_packing_and_speakers(spark):
    turns = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, T.pack_thread(turns)) == "a [TURN] b [LAST] c"
    assert one(spark, T.pack_thread(F.array(F.lit("a")))) == "[LAST] a"
    assert one(spark, T.reversed_context(turns)) == "b [TURN] a"
    assert one(spark, T.alternate_speakers(F.lit(4), F.lit("x"), F.lit("y"))) == ["y", "x", "y", "x"]


def test_seed_placement(spark):
    turns = F.array(F.lit("a"), F.lit("Seed "), F.lit("c"))
    assert one(spark, T.place_seed(turns, F.lit("seed"), True)) == ["a", "c", "seed"]
    assert one(spark, T.place_seed(turns, F.lit("seed"), False)) == ["a", "seed", "c"]
    assert one(spark, T.place_seed(turns, F.lit("new"), False)) == ["a", "new", "Seed ", "c"]


def test_romanise(spark):
    assert one(spark, T.romanise(F.col("t")), t="नमस्ते") == "namaste"
    assert one(spark, T.romanise(F.col("t")), t="Plain") == "plain"


def test_hashes(spark):
    import hashlib

    want = int(hashlib.md5(b"split|k").hexdigest()[:12], 16)
    assert one(spark, stable_int("split", F.col("k")), k="k") == want
    want = hashlib.sha256("Unknown chat\nhello".encode()).hexdigest()
    assert one(spark, incident_id(F.lit(" "), F.lit(" Hello "))) == want
    assert [one(spark, paired_split_name(F.lit(i))) for i in (10, 11, 12)] == ["test", "val", "train"]


def test_reply_parsing(spark):
    get = lambda raw: one(spark, P.reply_turns(F.col("r")), r=raw)
    assert get('x {"turns": ["a ", "b", "c  d"]} y') == ["a", "b", "c d"]
    assert get('{"messages": [{"text": "a"}, {"message": "b"}, "c"]}') == ["a", "b", "c"]
    assert get("- one\n2) two\nA: three") == ["one", "two", "three"]
    assert get("one\ntwo") is None
    strict = P.strict_turns(F.col("r"), F.lit(2), F.lit("Asha"), F.lit("Ravi"))
    assert one(spark, strict, r='<think>{"turns": []}</think>```json\n{"turns": ["A: hi", "Ravi: yo"]}\n```') == ["hi", "yo"]
    assert one(spark, strict, r='{"turns": ["only"]}') is None
    assert one(spark, strict, r='{"messages": ["a", "b"]}') is None  # the strict form takes turns only
    assert one(spark, P.reply_turns(F.col("r")), r='{"turns": "no list", "messages": ["a", "b", "c"]}') is None
    assert get('{"turns": ["{not json", "b", "c"]}') == ["{not json", "b", "c"]


def test_judge_and_verdict(spark):
    j = lambda raw: one(spark, P.judge(F.col("r")), r=raw)
    assert j('{"label": 1, "confidence": 0.9, "reason": "x"}')["label"] == 1
    assert j('{"label": 0}')["confidence"] == 0.5
    assert j('{"label": 7}') is None and j("none") is None
    v = lambda raw: tuple(one(spark, P.verdict(F.col("r")), r=raw))
    assert v('{"verdict": "softened", "confidence": 0.8}') == ("SOFTENED", 0.8)
    assert v("it is UNRELATED") == ("UNRELATED", 0.5) and v("?") == (None, 0.0)


def test_edit_distance_matches_table():
    import random

    def plain(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert S.edit_distance(a, b) == plain(a, b)


def test_gram_overlap_matches_counters():
    import random
    from collections import Counter

    rng = random.Random(2)
    for _ in range(40):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randint(0, 12))) for _ in range(2))
        for n, got in enumerate(S.gram_overlap(a, b, 4), 1):
            ca, cb = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            dot = sum(ca[g] * cb[g] for g in ca)
            want = (sum((ca & cb).values()), sum(ca.values()), sum(cb.values()), dot, sum(v * v for v in ca.values()), sum(v * v for v in cb.values()))
            assert got == want


def test_word_error_rate_and_references(spark):
    w = lambda a, b: one(spark, S.word_error_rate(T.word_list(F.col("a")), T.word_list(F.col("b"))), a=a, b=b)
    assert w("a b c d", "a x c") == 0.5 and w("", "") == 0.0 and w("", "a") == 1.0
    refs = lambda raw: one(spark, S.parse_references(F.col("r")), r=raw)
    assert refs("['a b', ' c ']") == ["a b", "c"] and refs('["x"]') == ["x"] and refs("plain") == ["plain"] and refs("  ") == []


def test_bleu_and_chrf_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat .", ["the cat sat on the mat ."])], ["id", "h", "r"])
    assert S.corpus_bleu(df, "id", "h", "r").first()["bleu"] == pytest.approx(1.0)
    pair = df.select("id", "h", F.get("r", F.lit(0)).alias("x"))
    assert S.corpus_chrf(pair, "h", "x").first()["chrf"] == pytest.approx(100.0)
    other = spark.createDataFrame([(1, "the cat sat on mat", ["the cat sat on the mat"])], ["id", "h", "r"])
    # 5/5, 3/4, 2/3, 1/2 with brevity exp(1 - 6/5)
    import math

    want = math.exp(1 - 6 / 5) * (1 * 0.75 * (2 / 3) * 0.5) ** 0.25
    assert S.corpus_bleu(other, "id", "h", "r").first()["bleu"] == pytest.approx(want)


def test_sentence_bleu_by_hand(spark):
    rows = [("full", "the cat sat on the mat", ["the cat sat on the mat"]), ("none", "x y", ["a b"]), ("short", "the cat", ["the cat sat"]), ("empty", "", ["a"]), ("two", "a b c d", ["q", "a b c d e"]), ("smooth", "a b c d e", ["a x c y e"])]
    got = {r["doc"]: r["bleu"] for r in S.sentence_bleu(spark.createDataFrame(rows, "doc string, h string, r array<string>"), "doc", "h", "r").collect()}
    assert got["full"] == pytest.approx(1) and got["none"] == got["empty"] == 0.0
    assert got["short"] == pytest.approx(math.exp(1 - 3 / 2))  # two words: orders 1 and 2 only
    assert got["two"] == pytest.approx(math.exp(1 - 5 / 4))  # the longer reference is the closest in length
    assert got["smooth"] == pytest.approx((3 / 5 * 1 / (2 * 4) * 1 / (4 * 3) * 1 / (8 * 2)) ** 0.25)


def test_edit_distance_equals_the_table():
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    draw = random.Random(4)
    for _ in range(500):
        a, b = ([draw.choice("abcde"[: draw.randrange(2, 6)]) for _ in range(draw.randrange(30))] for _ in range(2))
        assert S.edit_distance(a, b) == table(a, b)
