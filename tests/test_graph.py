"""Graph operators on hand-built notes."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgraph.corpus import KB, MINI_NOTES, corpus
from inkgraph.graph import KnowledgeGraph
from inkgraph.operators import graph, render, resolve, similarity
from inkgraph.plans import components, sieve
from inkgraph.plans.components import connected_components
from inkgraph.plans.prefix import numbered, prefix_sums
from inkgraph.plans.tables import Scratch, give_back


def made(spark, notes):
    return KnowledgeGraph(spark.createDataFrame(list(notes.items()), "path string, content string"))


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def plain_ranks(links, nodes, iterations=10):
    """Ranks by the formula: 0.15 / n plus 0.85 of the neighbours' shares, all at once."""
    rank = {x: 1 / len(nodes) for x in nodes}
    for _ in range(iterations):
        new = {x: 0.15 / len(nodes) for x in nodes}
        for a, b in links:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in links)
        rank = new
    return rank


def test_sample(spark):
    g = made(spark, {p: t for p, t in MINI_NOTES.items() if p.startswith("garden/")})
    links = [("thyme", "basil"), ("thyme", "beds"), ("beds", "thyme"), ("pruning", "beds"), ("pruning", "compost")]
    want = plain_ranks(links, ["basil", "beds", "compost", "pruning", "thyme"])
    assert {r["path"]: r["rank"] for r in g.pagerank().collect()} == pytest.approx({f"garden/{x}.md": v for x, v in want.items()})
    assert pairs(g.components, "component") == {("garden/basil.md",)}
    steps = g.shortest_path("pruning", "basil").orderBy("step").collect()
    assert [r["title"] for r in steps] == ["pruning.md", "beds.md", "thyme.md", "basil.md"]
    assert g.shortest_path("basil", "thyme").count() == 0
    words = {p: {w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) > 3} for p, t in MINI_NOTES.items()}
    score = len(words["garden/basil.md"] & words["garden/compost.md"]) / len(words["garden/basil.md"] | words["garden/compost.md"])
    best = g.similar("basil").head()
    assert best["title"] == "compost.md" and best["score"] == pytest.approx(score, abs=1e-6)
    first = g.suggest(0.1).head()
    assert (first["source"], first["target"]) == ("garden/basil.md", "garden/compost.md")
    assert pairs(resolve.backlinks(g.edges).where("path = 'garden/beds.md'"), "src") == {("garden/pruning.md",), ("garden/thyme.md",)}


def test_cycle_and_islands(spark):
    g = made(spark, {p: t for p, t in MINI_NOTES.items() if p.startswith(("ring/", "lone/"))})
    assert pairs(g.components, "component") == {("ring/Ash.md",), ("lone/left.md",), ("lone/pepper.md",), ("lone/hermit.md",)}
    assert pairs(g.orphans(), "path") == {("lone/hermit.md",)}
    assert pairs(g.islands(2), "component") == {("lone/left.md",), ("lone/pepper.md",)}
    assert g.islands(1).count() == 0
    assert [r["title"] for r in g.shortest_path("Oak", "Ash").orderBy("step").collect()] == ["Oak.md", "Elm.md", "Ash.md"]


def test_star_rank_single_and_empty(spark):
    g = made(spark, {"A.md": "", "B.md": "[[A]]", "C.md": "[[A]]", "D.md": "[[A]]"})
    ranks = {r["path"]: r["rank"] for r in g.pagerank().collect()}
    assert ranks["A.md"] == pytest.approx(0.133125) and ranks["B.md"] == pytest.approx(0.0375)
    solo = made(spark, {"Solo.md": ""})
    assert [r["rank"] for r in solo.pagerank().collect()] == pytest.approx([0.15])
    assert [r["title"] for r in solo.shortest_path("Solo", "Solo").collect()] == ["Solo.md"]
    none = KnowledgeGraph(spark.createDataFrame([], "path string, content string"))
    assert none.pagerank().count() == none.components.count() == none.orphans().count() == none.suggest().count() == 0
    assert none.shortest_path("a", "b").count() == 0 and none.communities.count() == 0


def test_resolution_order(spark):
    g = made(spark, {"b/x.md": "[[y]] [[y.md]] [[]] [[zz]] [[x.m]]", "a/my y.md": "", "c/y.md": "", "d/y.md": ""})
    got = {r["target"]: (r["dst"], r["match"]) for r in g.edges.collect()}
    assert got == {"y": ("c/y.md", "noext"), "y.md": ("c/y.md", "exact"), "": ("a/my y.md", "substring"), "zz": (None, None), "x.m": ("b/x.md", "substring")}


@pytest.mark.parametrize("threshold", [0.0, -1.0])
def test_suggestions_without_a_threshold(spark, threshold):
    notes = {"ant.md": "one word here", "bee.md": "other text there", "cat.md": "word here again [[dog]]", "dog.md": "nothing shared at all", "eel.md": "[[ant]]"}
    g = made(spark, notes)
    words = {p: {w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) > 3} for p, t in notes.items()}
    pairs_ = [(a, b) for a in notes for b in notes if a < b and (a, b) not in {("cat.md", "dog.md"), ("ant.md", "eel.md")}]
    score = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] and words[b] else 0.0
    want = sorted((-round(score(a, b), 4), a, b) for a, b in pairs_)[:6]
    assert [(-round(r["score"], 4), r["source"], r["target"]) for r in g.suggest(threshold, 6).collect()] == want
    assert g.suggest(threshold, 50).count() == len(pairs_)


def plain_communities(notes, links, passes=10):
    """One level of moves by modularity gain over the whole graph, a note at a time in the order of paths.

    ``links`` holds (source, target or None); a link weighs on both its ends, an unresolved one on its source.
    """
    total = len(links)
    degree = {x: sum(a == x for a, _ in links) + sum(b == x for _, b in links) for x in notes}
    own = {x: x for x in notes}
    for _ in range(passes if total else 0):
        moved = False
        for x in sorted(notes):
            near = {}
            for a, b in links:
                for y, z in ((a, b), (b, a)):
                    if y == x and z is not None:
                        near[own[z]] = near.get(own[z], 0) + 1
            best, most = own[x], 0.0
            for c in sorted(near):  # a community is named by the note it began with
                weight = sum(degree[y] for y in notes if own[y] == c)
                gain = near[c] / total - weight * degree[x] / (2.0 * total * total)
                if c != own[x] and gain > most:
                    best, most = c, gain
            if best != own[x]:
                own[x], moved = best, True
        if not moved:
            break
    groups = {}
    for x, c in own.items():
        groups.setdefault(c, set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(4))
def test_communities_by_a_plain_implementation(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(18)]
    targets = {x: [r.choice(names[: 9 if i < 9 else 18]) for _ in range(r.randint(0, 4))] + ["nowhere"] * (r.random() < 0.2) for i, x in enumerate(names)}
    g = made(spark, {f"{x}.md": " ".join(f"[[{t}]]" for t in ts) for x, ts in targets.items()})
    links = [(f"{x}.md", f"{t}.md" if t != "nowhere" else None) for x, ts in targets.items() for t in ts]
    groups = {}
    for row in g.communities.collect():
        groups.setdefault(row["community"], set()).add(row["path"])
    assert {frozenset(x) for x in groups.values()} == plain_communities([f"{x}.md" for x in names], links)
    first = [min(x) for _, x in sorted(groups.items())]
    assert sorted(groups) == list(range(len(groups))) and first == sorted(first)


def test_communities_refine_components(spark):
    g = made(spark, {"A.md": "[[B]]", "B.md": "[[C]]", "C.md": "", "D.md": "[[E]]", "E.md": "", "F.md": ""})
    got = g.communities.join(g.components, "path")
    assert got.groupBy("community").agg(F.count_distinct("component").alias("n")).where("n > 1").count() == 0
    assert got.count() == 6
    two = made(spark, {"A.md": "", "B.md": ""})
    assert len(pairs(two.communities, "community")) == 2


def test_context_and_missing(spark):
    g = made(spark, {"n.md": "---\nauthor: Alice\n---\n#important [[Other]]"})
    text = g.context("n.md")
    assert text == "### Node: n.md\n**Path:** n.md\n**Metadata:**\n- author: Alice\n**Tags:** #important\n\n### Connections\n- OUT: [[Other]] (Unresolved)\n"
    with pytest.raises(LookupError):
        g.context("no.md")
    with pytest.raises(LookupError):
        g.similar("nothing like it")


def test_csv_map(spark):
    head = "---\nsummary: Summary {0}\n"
    g = made(spark, {
        "a.md": head.format("A") + "problem: Problem A\nsolution: Solution A\naction: Action A\nnextPartOf: b.md\n---\n#tag1 #tag2 [[b]]",
        "b.md": head.format("B") + "previousPartOf: a.md\n---\n#tag3",
        "path/with,comma.md": "---\nsummary: A, B, and C\n---\n",
    })
    ids = {r["path"]: r["id"] for r in g.notes.collect()}
    a, b, c = ids["a.md"], ids["b.md"], ids["path/with,comma.md"]
    assert {r["line"] for r in render.csv_lines(g.csv_map()).collect()} == {
        f'{a},a.md,"tag1,tag2",Summary A,Problem A,Solution A,Action A,,{b},{b},',
        f"{b},b.md,tag3,Summary B,,,,{a},,,{a}",
        f'{c},"path/with,comma.md",,"A, B, and C",,,,,,,',
    }


def test_kb_fixture(spark):
    kb = corpus(spark, "/root/testdata/sf0.001", KB)
    digest = kb.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "content"))), lambda x: F.concat(x["path"], x["content"])), "")).alias("d")).head()["d"]
    assert digest == "f082e9a8dac5dfb2551ec2b4846f58d5"
    g = KnowledgeGraph(kb)
    stats = graph.graph_stats(g.notes, g.edges).head()
    assert tuple(stats) == (190, 313, 174, 5)
    assert sorted(r["size"] for r in graph.component_sizes(g.components).collect()) == [1] * 11 + [30, 32, 38, 39, 40]
    assert g.pagerank().agg(F.round(F.sum("rank"), 6)).head()[0] == 0.265471


def test_components_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 7), (8, None)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"))
    labels = {r["id"]: r["component"] for r in got.collect()}
    assert all(labels[i] == 0 for i in range(301)) and all(labels[1000 + i] == 1000 for i in range(200)) and labels[5000] == 5000
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_with_many_hubs(spark, monkeypatch):
    """Hubs, whose minima are broadcast, next to small groups and chains of hubs."""
    monkeypatch.setattr(components, "LEAST_HUB", 3)
    r = random.Random(4)
    edges = [(r.randrange(40) * 10, r.randrange(4000)) for _ in range(1500)] + [(5000 + i, 5001 + i) for i in range(50)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r["id"]: r["component"] for r in got.collect()} == label


def test_sieve(spark):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, str(i % 3), i) for i in range(300)], "a long, b string, _word long")
    keys = spark.createDataFrame([(3, "1"), (None, "2"), (9, "0"), (9, "0")], "a long, b string")
    for bits in (1 << 26, 64):
        concerned, clear = sieve.split(rows, ["a", "b"], keys, bits)
        assert concerned.columns == clear.columns == rows.columns
        x, y = ([tuple(g) for g in df.collect()] for df in (concerned, clear))
        assert sorted(map(str, x + y)) == sorted(str(tuple(g)) for g in rows.collect())
        wanted = {(3, "1"), (None, "2"), (9, "0")}
        assert not any(g[:2] in wanted for g in y) and (bits == 64 or {g[:2] for g in x} <= wanted)
    assert sieve.split(rows, ["a", "b"], keys.limit(0))[0].count() == 0


def test_prefix_sums_and_numbers(spark):
    rows = [(g, i // 7, i, (i * 37) % 11) for g in ("x", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, b long, i long, v long")
    got = prefix_sums(df, ["g"], "b", [F.col("i")], "v", "s", index="n").collect()
    assert len(got) == 120
    for r in got:
        assert r["s"] == sum((i * 37) % 11 for i in range(r["i"])) and r["n"] == r["i"]
    named = numbered(spark.range(100).select((F.col("id") * 3).alias("k")).repartition(7), "k", "n", Scratch(spark, "t")).collect()
    assert {(r["k"], r["n"]) for r in named} == {(3 * i, i) for i in range(100)}


def test_written_tables_give_native_memory_back(spark, monkeypatch):
    """The driver's JVM is asked after each table; it can be, if it is a recent one on Linux."""
    from inkgraph.plans import tables

    asked = []
    monkeypatch.setattr(tables, "give_back", lambda s: asked.append(give_back(s)))
    assert Scratch(spark, "t").keep(spark.range(3), "t").count() == 3
    version = spark.sparkContext._jvm.java.lang.Runtime.version()
    recent = version.feature() > 17 or version.feature() == 17 and version.update() >= 9
    assert asked == [recent and "linux" in spark.sparkContext._jvm.System.getProperty("os.name").lower()]


def test_class_pairs_against_all_pairs(spark):
    import random

    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(40)]
    texts = {f"{i:03d}.md": " ".join(r.sample(vocabulary, r.randint(0, 12))) for i in range(120)} | {"x.md": "", "y.md": "word1 word2", "z.md": "word2 word1"}
    g = made(spark, texts)
    sets = {p: {w for w in t.split() if len(w) > 3} for p, t in texts.items()}
    first = {}
    for p in sorted(sets):
        first.setdefault(frozenset(sets[p]), p)
    for t in (0.2, 0.5, 0.8):
        want = {(a, b) for a in first.values() for b in first.values() if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-9}
        assert pairs(similarity.class_pairs(g.notes, t), "source", "target") == want
    with pytest.raises(ValueError):
        similarity.class_pairs(g.notes, 0)


def test_pairs_are_met_without_rows_for_them(spark, monkeypatch):
    """Sets that share a rare word or two and nothing else are no rows; blocks, passes and parts lose no pair."""
    from inkgraph.operators import set_join

    r = random.Random(9)
    vocabulary = [f"plain{i}" for i in range(300)]
    texts = {f"{i:03d}.md": " ".join([f"rare{i % 3}", *r.sample(vocabulary, 30)]) for i in range(150)}
    for i in range(0, 150, 5):
        words = texts[f"{i:03d}.md"].split()
        texts |= {f"{i:03d}-{k}.md": " ".join(words[: len(words) - k] + [f"own{i}x{j}" for j in range(k)]) for k in (0, 4, 9, 15)}
    texts |= {f"s{i}.md": f"word{i % 4} word{i % 3}" for i in range(20)}
    raw = spark.createDataFrame([*texts.items(), (None, "no path here"), ("000.md", texts["000.md"])], "path string, content string")
    sets = {p: frozenset(t.split()) for p, t in texts.items()}
    first = {}
    for p in sorted(sets):
        first.setdefault(sets[p], p)
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = sorted((a, b, pytest.approx(alike(a, b), abs=1e-6)) for a in first.values() for b in first.values() if a < b and alike(a, b) >= 0.5)
    for most, block, words in ((1 << 15, 1 << 13, 6_000_000), (25, 4, 6_000_000), (1 << 15, 1 << 13, 1500)):
        monkeypatch.setattr(similarity, "PASS_SETS", most)
        monkeypatch.setattr(similarity, "PASS_WORDS", words)
        monkeypatch.setattr(set_join, "BLOCK_SETS", block)
        got = similarity.class_pairs(raw, 0.5)
        assert sorted(map(tuple, got.collect())) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    names = sorted(first.values(), key=lambda p: len(sets[p]))
    of = [sets[p] for p in names if p[0] != "s" and "-" not in p]
    sizes, code = np.array([len(x) for x in of]), {w: i * 0x9E3779B97F4A7C15 % (1 << 64) for i, w in enumerate(sorted(set().union(*of)))}
    flat = np.array([code[w] for x in of for w in x], np.uint64).view(np.int64)
    found = set_join.ordered(flat, sizes, np.zeros(1 << set_join.RARITY_BITS, np.uint8))
    met = sum(int((i != j).sum()) for _, b in set_join.blocks(sizes, found, 0.5) for i, j in b.candidates(sizes, found))
    # Two sets of 31 words of 300 share three or so, and nearly all pairs one at least.
    assert met < 0.1 * len(of) ** 2


def test_suggestions_expand_copies(spark):
    g = made(spark, {f"n{i}.md": "some shared words here" for i in range(5)} | {"m.md": "[[n0]] other words shared"})
    got = g.suggest(0.2, 3).collect()
    assert [(r["source"], r["target"], r["score"]) for r in got] == [("n0.md", "n1.md", 1.0), ("n0.md", "n2.md", 1.0), ("n0.md", "n3.md", 1.0)]


def test_suggestions_are_the_first_unlinked_pairs(spark):
    """Against all pairs, with classes whose first notes are linked to many others of theirs."""
    r = random.Random(4)
    texts = ["some shared words here", "some shared words there", "other shared things", "alone"]
    raw = {}
    for i in range(60):
        links = "".join(f" [[{r.choice(['n', 'n0', 'n1', 'n2', 'n17'])}]]" for _ in range(2)) if i % 10 < 3 else ""
        raw[f"n{i:02}.md"] = r.choice(texts) + links
    g = made(spark, raw)
    notes = {x["path"]: (x["title"], [y["target"] for y in x["links"]]) for x in g.notes.collect()}
    words = {x["path"]: set(x["words"]) for x in similarity.word_sets(g.notes).collect()}
    linked = lambda a, b: any(t in notes[b][0] for t in notes[a][1])
    pairs = [(a, b, len(words[a] & words[b]) / len(words[a] | words[b])) for a in words for b in words if a < b and words[a] & words[b]]
    want = sorted((-round(x, 6), a, b) for a, b, x in pairs if x >= 0.1 and not linked(a, b) and not linked(b, a))
    for k in (1, 10, 300, 5000):
        assert [(-x["score"], x["source"], x["target"]) for x in g.suggest(0.1, k).collect()] == [(pytest.approx(x, abs=2e-6), a, b) for x, a, b in want[:k]], k


def test_copies_are_not_all_paired(spark):
    """A class of n notes is expanded to fewer than n pairs for each note taken of it."""
    classes = spark.createDataFrame([("a", f"{i:05}") for i in range(5000)], "rep string, path string")
    of = spark.createDataFrame([("a", "a", 1.0)], "source string, target string, score double")
    sources = similarity._class_sources(of, classes, 0, 1)
    assert [x["path"] for x in sources.collect()] == ["00000"] and similarity._partners(sources, classes).count() == 4999
