import hashlib
import random

import pytest
from pyspark.sql import functions as F

from braidworks.llm import preference, urltree
from braidworks.llm.queries import RULES

PARSED = [urltree.Rule.parse(line) for line in RULES]


def brute(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in PARSED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def pages(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return df.withColumns({c: F.lit("x") for c in ("host", "path", "shape", "template", "n", "rule")})


def test_rules_match_a_scan(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "https://a.Example.com/en/7x?q", "http://notexample.com/en/7", "http://x.com/en", "ftp://a.net/de/8", "http://example.net/de/81#f", "http://org/es/", "x://y://z/en/", "http://É.com/en/1", "http://a.org?x/es/", "http://a.com:80/en/1", "http://a.com/en/1\n2?z", "//a.com/en/"]
    got = urltree.judge_urls(pages(spark, urls + urls), PARSED).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, rule, verdict = brute((urls + urls)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urltree.judge_urls(pages(spark, []), PARSED).count() == 0


def labelled(spark, rows):
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad int")
    return {r.page_id: r for r in urltree.judge_urls(df, [], F.col("bad")).collect()}


def test_variable_segments_become_wildcards(spark):
    draw = random.Random(1)
    slug = lambda: "".join(draw.choice("abcdefgh") for _ in range(8))
    rows = [(f"http://h/item/{slug()}", 1 if i < 30 else None) for i in range(60)] + [(f"http://h/about/{p}", 0) for p in ("team", "press", "jobs") for _ in range(10)]
    got = labelled(spark, rows)
    assert {got[i].template for i in range(60)} == {"/item/*"} and all(got[i].verdict == "block" for i in range(60))
    assert all(got[i].verdict == "allow" for i in range(60, 90))


def test_like_branches_merge_and_carry_their_labels(spark):
    rows = [(f"http://h/u{c}/{i}", 1 if c in "abc" else None) for c in "abcdef" for i in range(20)] + [("http://other/x/1", 0)] * 30
    got = labelled(spark, [(u.replace("/ua", "/alpha").replace("/ub", "/beta").replace("/uc", "/gamma").replace("/ud", "/delta").replace("/ue", "/epsilon").replace("/uf", "/zeta"), b) for u, b in rows])
    assert {got[i].template for i in range(120)} == {"/~/{n}"}
    assert all(got[i].verdict == "block" for i in range(120)) and got[120].verdict == "allow"


def test_branches_with_other_labels_stay_apart(spark):
    rows = [(f"http://h/good/{i}", 0) for i in range(40)] + [(f"http://h/bad/{i}", 1) for i in range(40)] + [(f"http://h/unknown/{i}", None) for i in range(40)]
    got = labelled(spark, rows)
    assert all(got[i].verdict == "allow" for i in range(40)) and all(got[i].verdict == "block" for i in range(40, 80)) and all(got[i].verdict == "allow" for i in range(80, 120))


def test_a_branch_without_labels_is_judged_by_the_evidence_above_it(spark):
    got = labelled(spark, [(f"http://h/bad/{i}/a{i}", 1) for i in range(40)] + [("http://h/unknown/x/y", None), ("http://other/x", None), ("http://other/y", 0)])
    assert got[40].verdict == "block" and got[41].verdict == "allow"


def brute_tree(rows):
    """Templates, purities and rejections of rows (host, segments, bad), a node at a time."""
    labels = [b for _, _, b in rows if b is not None]
    total, out = sum(labels) / max(1, len(labels)), {}

    def share(some, above):
        own = [b for _, _, b in some if b is not None]
        return (sum(own) + 2.0 * above) / (len(own) + 2.0)

    def grow(some, template, above, host_labels):
        purity, rests = share(some, above), [r for _, r, _ in some]
        k = 0
        while all(len(r) > k for r in rests) and len({r[k] for r in rests}) == 1:
            k += 1
        template += "".join("/" + s for s in rests[0][:k])
        some = [(s, r[k:], b) for s, r, b in some]
        for s, r, _ in some:
            if not r:
                out[s] = (template, purity, purity >= urltree.REJECT_PURITY and host_labels >= urltree.LEAST_LABELS)
        some = [x for x in some if x[1]]
        children, steps = {}, {}
        for x in some:
            children.setdefault(x[1][0], []).append(x)
        after = lambda xs: {a: sum((x[1][1] if len(x[1]) > 1 else "/") == a for x in xs) / len(xs) for a in {x[1][1] if len(x[1]) > 1 else "/" for x in some}}
        pooled = after(some) if some else {}
        known = lambda xs: [x[2] for x in xs if x[2] is not None]
        for name, xs in children.items():
            distance = sum(abs(after(xs)[a] - pooled[a]) for a in pooled) / 2
            mine, every = known(xs), known(some)
            others = len(every) - len(mine)
            if not mine:
                agree = sum(bool(known(c)) for c in children.values()) != 1
            elif not others:
                agree = False
            else:
                rate = sum(every) / len(every)
                agree = abs(sum(mine) / len(mine) - (sum(every) - sum(mine)) / others) <= urltree.MERGE_Z * (rate * (1 - rate) * (1 / len(mine) + 1 / others)) ** 0.5
            varies = len(children) >= urltree.VARIABLE_CHILDREN and len(children) >= urltree.VARIABLE_SHARE * len(some)
            steps[name] = "*" if varies else "~" if len(children) > 1 and distance <= urltree.MERGE_DISTANCE + 1e-9 and agree else name
        for step in set(steps.values()):
            grow([(s, r[1:], b) for s, r, b in some if steps[r[0]] == step], template + "/" + step, purity, host_labels)

    for host in {h for h, _, _ in rows}:
        mine = [((host, tuple(s)), tuple(s), b) for h, s, b in rows if h == host]
        grow(mine, "", total, sum(b is not None for _, _, b in mine))
    return out


def test_tree_matches_a_walk_over_its_nodes(spark):
    draw = random.Random(7)
    rows = []
    for host in ("a", "b", "c"):
        for _ in range(160):
            head = draw.choice(["en", "de", "fr", "shop"])
            segments = [head, *draw.choice([["item", draw.choice("pqrstuvwxyz") * draw.randint(1, 9), "view"], [draw.choice(["x", "y"]), "{n}"], ["{n}"], [], ["deep", *"abcdefghijkl"[: draw.randint(0, 12)]]])]
            bad = draw.choice([None, None, 1, int(head in ("en", "shop") and host != "c")])
            rows.append((host, segments, bad))
    rows += [("lone", ["x"] * 300 + ["y"], None), ("", [], None), ("", [], 1)]
    got = urltree.learn_templates(spark.createDataFrame(rows, "host string, shape array<string>, bad int")).collect()
    expected = brute_tree(rows)
    found = {(r.host, tuple(r.shape)): (r.template, r.purity, r.rejected) for r in got}
    assert len(got) == len(found) and found.keys() == expected.keys()
    for k, (template, purity, rejected) in expected.items():
        assert found[k][0] == template and abs(found[k][1] - purity) < 1e-9 and found[k][2] == rejected, k
    assert {r for _, _, r in expected.values()} == {True, False}


def test_urls_without_a_rule_get_both_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.verdict: r["count"] for r in urltree.judge_urls(pages, PARSED).where("rule is null").groupBy("verdict").count().collect()}
    assert got["block"] > 100 and got["allow"] > 100


def test_a_path_is_judged_by_the_same_path_elsewhere_before_its_host_is(spark):
    rows = [(f"http://a.x.com/en/{i}", 1) for i in range(30)] + [(f"http://b.y.net/de/{i}", 0) for i in range(30)]
    rows += [("http://a.x.com/de/1", None), ("http://b.y.net/en/1", None), ("http://a.x.com/fr/1", None), ("http://c.x.com/en/1", None), ("http://new.org/en/1", None), ("http://new.org/de/1", None)]
    got = labelled(spark, rows)
    assert [got[i].verdict for i in range(60, 66)] == ["allow", "block", "block", "block", "block", "allow"]


def brute_scopes(rows):
    """Purities and rejections by walks over the trees of hosts, domains and all."""
    domain = lambda h: ".".join(h.split(".")[-2:])
    trees = {name: brute_tree([(of(h), s, b) for h, s, b in rows]) for name, of in (("host", lambda h: h), ("domain", domain), ("all", lambda h: "all"))}
    out = {}
    for host, shape in {(h, tuple(s)) for h, s, _ in rows}:
        purity, labels = trees["host"][host, shape][1], {}
        for name, key in (("all", lambda h: "all"), ("domain", domain), ("host", lambda h: h)):
            tree, mine = trees[name], key(host)
            own = [b for h, s, b in rows if b is not None and key(h) == mine and tree[mine, tuple(s)][0] == tree[mine, shape][0]]
            purity, labels[name] = (sum(own) + 2.0 * purity) / (len(own) + 2.0), len(own)
        known = max(labels["all"], sum(b is not None for h, _, b in rows if h == host)) >= urltree.LEAST_LABELS
        out[host, shape] = (purity, purity >= urltree.REJECT_PURITY and known)
    return out


def test_scopes_match_walks_over_their_trees(spark):
    draw, rows = random.Random(12), []
    for host in ("a.x.com", "b.x.com", "c.y.net", "lone"):
        for _ in range(90):
            segments = [draw.choice(["en", "de", "fr"]), *draw.choice([["{n}"], ["item", draw.choice("pqrstuvw") * draw.randint(1, 5)], []])]
            rows.append((host, segments, draw.choice([None, None, int(segments[0] == "en")]) if host[0] in "ac" else None))
    got = urltree.scoped_templates(spark.createDataFrame(rows, "host string, shape array<string>, bad int")).collect()
    expected = brute_scopes(rows)
    assert {(r.host, tuple(r.shape)): r.rejected for r in got} == {k: v[1] for k, v in expected.items()} and len(got) == len(expected)
    assert all(abs(r.purity - expected[r.host, tuple(r.shape)][0]) < 1e-9 for r in got) and {r.rejected for r in got} == {True, False}


def test_hosts_have_both_verdicts_among_urls_without_a_rule(spark):
    rows = urltree.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), PARSED).where("rule is null").select("host", "verdict").distinct().groupBy("host").count()
    assert rows.where("count = 2").count() > 10


def test_few_labels_reject_nothing(spark):
    got = labelled(spark, [("http://h/a/1", 1), ("http://h/a/2", 1), ("http://h/a/3", None)])
    assert all(r.verdict == "allow" for r in got.values())


def test_too_many_rules_fail(spark):
    with pytest.raises(ValueError, match="rules"):
        urltree.judge_urls(pages(spark, []), PARSED * 300)


# Preferences.


def brute_pair(a, b):
    a, b = ([(r or "", x or "") for r, x in side] for side in (a, b))
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    line = lambda t: f"{t[0] or ''}: {t[1] or ''}\n"

    def side(turns):
        text, mask = "", []
        for t in turns[n:]:
            start = len(text) + len(t[0] or "") + 2
            text += line(t)
            if t[0] == "assistant":
                mask.append((start, len(text)))
        return text, mask

    return n, "".join(map(line, a[:n])), *side(a), *side(b)


def test_pairs_match_a_scan(spark):
    draw = random.Random(4)
    talk = lambda n: [(("user", "assistant")[i % 2], draw.choice(["hi", "ho", "", "é🙂", None])) for i in range(n)]
    rows, expected = [], {}
    for k in range(40):
        head = talk(draw.randint(0, 3))
        a, b = head + talk(draw.randint(0, 3)), head + talk(draw.randint(0, 3))
        expected[k] = brute_pair(a, b)
        rows += [(2 * k, i, *t) for i, t in enumerate(a)] + [(2 * k + 1, i, *t) for i, t in enumerate(b)]
    draw.shuffle(rows)
    conversations = spark.createDataFrame(rows + [(None, 0, "user", "lost")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("prompt", "a", "b", "pair_id", "n_common")})
    pairs = spark.createDataFrame([(k, 2 * k, 2 * k + 1) for k in range(40)] + [(99, None, 5000)], "pair_id long, chosen_id long, rejected_id long")
    expected[99] = brute_pair([], [])
    got = preference.format_preferences(conversations, pairs).collect()
    spans = lambda m: [(s.start, s.end) for s in m]
    assert {r.pair_id: (r.n_common, r.prompt, r.chosen, spans(r.chosen_mask), r.rejected, spans(r.rejected_mask)) for r in got} == expected
    assert preference.format_preferences(conversations.limit(0), pairs.limit(0)).count() == 0


def test_equal_conversations_are_all_prompt(spark):
    rows = [(c, t, r, x) for c in (0, 1) for t, r, x in ((0, "user", "q"), (1, "assistant", "a"), (1, "assistant", "a"))]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.format_preferences(conversations, spark.createDataFrame([(7, 0, 1)], "pair_id long, chosen_id long, rejected_id long")).first()
    assert (got.pair_id, got.n_common, got.chosen, got.rejected, got.chosen_mask) == (7, 3, "", "", [])


def test_branches_share_their_first_turns(spark):
    big = (1 << 60) + 3
    talks = {c: [(("user", "assistant")[i % 2], f"{c} says {i}") for i in range(n)] for c, n in ((4, 5), (5, 3), (9, 4), (big, 6), (big - 1, 2), (12, 1), (20, 3000), (21, 4000))}
    rows = [(c, i, *t) for c, talk in talks.items() for i, t in enumerate(talk)]
    conversations = spark.createDataFrame([*rows, (None, 0, "user", "lost"), (30, None, None, None)], "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "n", "keep", "pair_id", "is_chosen")})
    talks[30] = [("", "")]
    got = {r.pair_id: r for r in preference.format_turns(preference.branched(conversations)).collect()}
    assert got.keys() == talks.keys()
    for c, talk in talks.items():
        keep = int(hashlib.md5(str(c).encode()).hexdigest()[:8], 16) % max(min(len(talk), len(talks.get(c ^ 1, talk))) - 1, 1) + 1
        n, prompt, chosen, mask, rejected, other_mask = brute_pair(talk, talk[:keep] + talks.get(c ^ 1, [])[keep:])
        r = got[c]
        assert n == min(keep, len(talk)) and (r.n_common, r.prompt, r.chosen, r.rejected) == (n, prompt, chosen, rejected)
        assert [tuple(s) for s in r.chosen_mask] == mask and [tuple(s) for s in r.rejected_mask] == other_mask
    assert preference.format_turns(preference.branched(conversations.limit(0))).count() == 0
