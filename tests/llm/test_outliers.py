"""Documents that pass the base rules but lie far outside their group."""

import numpy as np

from parleyspark.llm import adaptive_rules


def test_outliers_of_a_clean_group_go(spark):
    draw = np.random.default_rng(0)

    def text(n, line=10):
        found = [f"w{x}" for x in draw.integers(0, 10**8, n)]
        return [" ".join(found[at : at + line]) for at in range(0, n, line)]

    rows = [(i, "\n".join(text(300))) for i in range(80)]
    plain = text(930)
    rows.append((100, "\n".join([*plain[:80], *plain[20:27], *plain[80:]])))  # 140 of 1000 words: inside the fence
    rows.append((101, "\n".join([*plain[:80], *plain[20:28], *plain[80:]]) + "\n" + "\n".join(plain[40:42])))  # 200 of 1030
    lines = text(90, line=3)
    rows.append((102, "\n".join([*lines, *[lines[k] for k in draw.permutation(len(lines))]])))  # half of the lines
    short = text(120)
    rows.append((103, "\n".join([*short, short[3]])))  # one line twice, as clean texts have it
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in adaptive_rules.adaptive_rules(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert all(got[i]["kept"] for i in [*range(80), 100, 103])
    assert not got[101]["kept"] and not got[102]["kept"]
    assert 0.142 < got[101]["n_repeat_words"] / got[101]["n_words"] < 0.2
