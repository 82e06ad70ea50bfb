import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import line_dedup, mixing, quality_rules, url_filter
from lumenfold.llm.queries import URL_RULES

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        for name in ("n_lines", "host", "size", "taken", "kept", "n_words", "_row", "_site", "shard", "label"):
            df = df.withColumn(name, F.lit("clash"))
    return df


# Line dedup


def brute_lines(rows, ratio, least):
    by = {}
    for _, text, source in rows:
        if source is not None:
            t = by.setdefault(source, [0, {}])
            t[0] += 1
            for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
                t[1][line] = t[1].get(line, 0) + 1
    out = []
    for i, text, source in rows:
        n, c = by.get(source, (0, {}))
        bad = {x for x, k in c.items() if k >= least and k > ratio * n}
        out.append((i, None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" ") not in bad)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("force", ["arrays", "broadcast", "shuffle", None])
def test_lines_match_brute_force(spark, force):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", "foot", "", "a b", f"own {rng.randrange(400)}"]) for _ in range(rng.randrange(12))), rng.choice(["hot", "hot", "hot", "x", None])) for i in range(300)]
    rows += [(900, None, "hot"), (901, "", "hot"), (902, "menu", "lone"), (903, "long " * 20000 + "\nmenu", "hot"), (5, rows[5][1], rows[5][2])]
    got = line_dedup.drop_boilerplate(docs(spark, rows, extra=True), ratio=0.3, min_pages=3, force=force, salts=4)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute_lines(rows, 0.3, 3)
    dropped = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.where("doc_id >= 900").collect()}
    assert dropped[900] == (0, 0) and dropped[902] == (1, 0) and dropped[903] == (2, 1)
    assert got.columns.count("n_lines") == 1 and "_row" in got.columns


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


# URLs


def brute_url(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(fit)
    return host, path, best[3], best[2]


@pytest.mark.parametrize("force", ["broadcast", "shuffle"])
def test_urls_match_brute_force(spark, force):
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "a.net", "net", "x.y.net", "com", "example.com.", "notexample.com", "é.com", "a..net", "u@b.com:80", ""]
    paths = ["", "/", "/en/", "/en/a", "/en", "/es/x", "/fr/", "/EN/", "//", "/en/\nq"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#f", "?a#b")]
    urls += [None, "", "no scheme", "http:/x", "a://b://c/d", "http://example.com?x=/en/", "x://" + "a." * 40 + "com/" + "p/" * 900, urls[3], urls[3]]
    rules = [*URL_RULES, ("com", "/en/aa", "block"), ("a.net", "/", "block"), ("net", "/es/x", "allow"), ("b.com:80", "/e", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "_row": F.lit(2), "rule": F.lit(3)})
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), force=force, salts=3)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert got.count() == len(urls)


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r)[2:] for r in url_filter.filter_urls(pages, none, default="block").collect()] == [("a.com", "/", None, "block")]
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, spark.createDataFrame([("a", "/" * 3000, "block")], url_filter.RULE_SCHEMA))


def test_conflicting_rules_block(spark):
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block")], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, rules).first()["verdict"] == "block"


# Mixing


def water_filling(sizes, share=1.5, most=2.0):
    """Targets of sources in their order, one at its bound at a time."""
    weight = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free and left > 0:
        total = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / total >= most * sizes[k]]
        for k in over or free:
            out[k] = most * sizes[k] if over else left * weight[k] / total
        if not over:
            break
        left -= sum(out[k] for k in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 0, 50], [7], [0, 0], [], [10**6, 1, 1, 1, 5, 900], list(range(1, 200))])
def test_targets_water_filling(spark, sizes):
    table = spark.createDataFrame(list(enumerate(sizes)), "source long, source_size long")
    got = {r.source: r.target for r in mixing.targets(table, mixing.MixConfig()).collect()}
    assert [got[k] for k in range(len(sizes))] == pytest.approx(water_filling(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_split_tree_is_exact_and_spread():
    import numpy as np

    q = np.array([1000, 37, 0, 5])
    got = mixing.split_quotas(q, 13, np.random.default_rng(1))
    assert got.shape == (13, 4) and (got.sum(0) == q).all() and (got >= 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 4
    assert (got[:, 0] > 40).all()


def mixed_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 300, 2000])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    return rows + [(700, None, "a"), (701, "", "only-empty"), (702, "x\u00a0y\x0bz", "b"), (3, rows[3][1], rows[3][2])]


def test_takes_come_near_their_targets(spark):
    rows = mixed_rows(spark)
    got = mixing.takes(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(SPLIT.findall(t or "")) for _, t, _ in rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r.size
        s[1] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = water_filling([by[s][0] for s in names])
    for s, t in zip(names, want, strict=True):
        assert by[s][2] == by[s][0] and by[s][3] == pytest.approx(t)
        assert abs(by[s][1] - t) <= max(1, 0.01 * t), (s, by[s], t)


def test_mix_repeats_rows_as_taken_and_agrees_with_itself(spark):
    rows = mixed_rows(spark)
    a, b = docs(spark, rows), docs(spark, rows[::-1]).repartition(7)
    m = mixing.mix(a).select("doc_id", "round", "shard", "place")
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixing.mix(b).select("doc_id", "round", "shard", "place").collect()))
    times = {r.doc_id: r["count"] for r in m.groupBy("doc_id").count().collect()}
    shards = {r.doc_id: sorted(r.s) for r in m.groupBy("doc_id").agg(F.collect_list("shard").alias("s")).collect()}
    for r in mixing.takes(a).where("doc_id <> 3 and size > 0").collect():
        assert times.get(r.doc_id, 0) * r.size == r.taken and sorted(r.shards) == shards.get(r.doc_id, [])


def test_shards_come_from_the_tree(spark):
    """A block's draw is in one shard, shards hold disjoint draws, and another tree gives other shards."""
    rows = mixed_rows(spark)
    df = docs(spark, rows).where("doc_id <> 3").dropDuplicates(["doc_id"])
    found = {n: {r.doc_id: r for r in mixing.takes(df, mixing.MixConfig(shards=n)).collect()} for n in (1, 5)}
    assert {s for r in found[1].values() for s in r.shards} == {0} and {s for r in found[5].values() for s in r.shards} == set(range(5))
    assert all(r.taken == r.size * len(r.shards) and r.taken == found[1][i].taken for i, r in found[5].items())
    again = {r.doc_id: r.shards for r in mixing.takes(df, mixing.MixConfig(shards=5, seed=24)).collect()}
    assert again != {i: r.shards for i, r in found[5].items()}
    drawn = mixing.mix(df, mixing.MixConfig(shards=5)).select("doc_id", "round", "shard", "place").collect()
    assert len({(r.doc_id, r["round"]) for r in drawn}) == len(drawn) == sum(len(r.shards) for r in found[5].values())
    sizes = {k: sum(r.shard == k for r in drawn) for k in range(5)}
    assert max(sizes.values()) < 2 * min(sizes.values())


def test_groups_of_sources_share_a_quota(spark):
    """More sources than groups: the driver has one quota a group, and every draw has its shard."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), f"s{i % 90:02d}") for i in range(1800)]
    got = mixing.takes(docs(spark, rows), mixing.MixConfig(groups=4, shards=6)).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target])
        s[0] += r.taken
    assert all(abs(n - t) <= max(2, 0.02 * t) for n, t in by.values()), by
    per = [sum(r.shards.count(k) for r in got) for k in range(6)]
    assert min(per) > 0 and max(per) < 2 * min(per)


@pytest.mark.parametrize("most", [12, 1 << 18])
def test_few_blocks_still_meet_the_targets(spark, most):
    """More sources than blocks, one of them with half of all rows; the join by source broadcast and not."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "hot" if i % 2 else f"s{i % 34:02d}") for i in range(1500)]
    for cfg in (mixing.MixConfig(most_blocks=most), mixing.MixConfig(most_blocks=most, broadcast_rows=0, salts=3)):
        by = {}
        got = mixing.takes(docs(spark, rows), cfg).collect()
        assert len(got) == len(rows)
        for r in got:
            s = by.setdefault(r.source, [0, r.target])
            s[0] += r.taken
        assert all(abs(n - t) <= max(2, 0.005 * t) for n, t in by.values()), by
        times = {r.doc_id: r["count"] for r in mixing.mix(docs(spark, rows), cfg).groupBy("doc_id").count().collect()}
        assert all(times.get(r.doc_id, 0) * r.size == r.taken for r in got)


def test_a_source_of_one_block_is_taken_in_part(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "abc"[i % 3]) for i in range(300)]
    by = {}
    for r in mixing.takes(docs(spark, rows), mixing.MixConfig(most_blocks=1)).collect():
        by[r.source] = (by.get(r.source, (0, 0))[0] + r.taken, r.target, r.source_size)
    assert any(0.1 < (t / n) % 1 < 0.9 for _, t, n in by.values())
    assert all(abs(n - t) <= 0.01 * t for n, t, _ in by.values()), by


def test_mix_of_nothing(spark):
    assert mixing.takes(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


# Quality rules


def brute_rules(text):
    t = text or ""
    w = SPLIT.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in wins:
        count[x] = count.get(x, 0) + 1
    covered = {p for i, x in enumerate(wins) if count[x] > 1 for p in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules_match_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a", "a b c d", "a b c d e", "a a a a a a a a", "x y z v w " * 3, "\n\na\na\n a\na ", "é ß 漢字 🤗🤗 ü", "#*$%&|<> <b>", "w\u00a0v\u2003u", "long " * 30000, "p q r s t\n" * 50]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))) + rng.choice(["", "\n"]) + "\n".join(rng.choice(["l m", "k", ""]) for _ in range(rng.randrange(8))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"kept": F.lit("x"), "n_words": F.lit(0), "_words": F.lit(1)})
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(df).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_rules_keep_prose_and_name_what_failed(spark):
    prose = "the quick brown fox jumps over the lazy dog and then it runs to the river in the evening"
    rows = [(1, prose, "s"), (2, prose.upper(), "s"), (3, " ".join(w + "##" for w in prose.split()), "s"), (4, "too short", "s")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs(spark, rows)).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[4].kept
    assert got[2].failed_rules == ["upper_word_ratio"] and got[3].failed_rules == ["symbols_per_word"] and "n_words" in got[4].failed_rules
    assert quality_rules.apply_rules(docs(spark, [])).count() == 0


def test_rules_are_one_projection_without_python(spark):
    plan = quality_rules.apply_rules(docs(spark, [(1, "a", "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
