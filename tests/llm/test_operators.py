"""Operators against brute force, on small tables with odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgraph.llm import chat, decontaminate, language, licenses, mixing, near_dup, pii, quality, queries
from inkgraph.llm.registry import QUERIES
from inkgraph.llm.textbuf import Texts
from inkgraph.llm.token_files import token_file_digests, written_and_read, read_token_files, write_token_files
from inkgraph.llm.tokens import token_counts
from inkgraph.plans.tables import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd(extra=()):
    """Rows with nulls, empty and long texts, ties and repeats."""
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma,", "Delta.", "épsilon", "z" * 40]) for _ in range(9000))
    rows = [
        (1, "one two three", "en", "a", 13), (2, None, "en", "a", 0), (3, "", None, "b", 0), (4, " \n\t ", "fr", None, 4), (None, "null id here", "en", "c", 12),
        (5, long, "en", "c", len(long)), (6, "same text", "de", "b", 9), (6, "same text", "de", "b", 9), (7, "ONE two three", "en", "a", 13), (8, "12 34 !!", "en", "d", 8),
    ]
    return [*rows, *extra]


def docs(spark, rows=None):
    return spark.createDataFrame(odd() if rows is None else rows, DOCS)


def clashing(df):
    """Columns named as operators name theirs."""
    for c in ("size", "_th", "_n", "component_id", "fp", "sig", "_ok", "_gone", "taken", "ok", "spans", "Score"):
        df = df.withColumn(c, F.lit("x"))
    return df


# Personal data.


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_spans():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("01234567890123456789.....@@+- ()ab%_\né٣") for _ in range(r.randint(0, 60)))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == brute_pii(t), t
    for _ in range(500):
        d = "".join(r.choice("0123456789") for _ in range(r.choice([14, 15, 16, 17, 18, 19])))
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        t = "a " + r.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4)) + " b"
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == brute_pii(t)


def test_pii_added_spans():
    t = "IBAN: DE89 3704 0044 0532 0130 00 then https://u@ex.com:80/a?b#c. at 12 Main Oak Street."
    assert {(k, t[a:b]) for k, a, b in pii.find_spans(t) if k in pii.ADDED} == {
        ("iban", "DE89 3704 0044 0532 0130 00"), ("url", "https://u@ex.com:80/a?b#c"), ("street", "12 Main Oak Street"),
    }
    assert not pii.find_spans("an account of the Street, iban none; http:// nothing xhttp://a")
    found = {
        'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y': {("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")},
        "API_KEY: sk-Zz12_34567890.": {("secret", "sk-Zz12_34567890")},
        "Authorization: Bearer abcDEF123456==": {("secret", "abcDEF123456==")},
        "db.password=>'hunter2hunter2'": {("secret", "hunter2hunter2")},
        "Er wohnt Lange Straße 12a, sie Birkenallee 7.": {("street", "Lange Straße 12a"), ("street", "Birkenallee 7")},
        "au 12 bis, rue de la Paix et 5 avenue d'Italie": {("street", "12 bis, rue de la Paix"), ("street", "5 avenue d'Italie")},
        "vive en Calle de Alcalá, 12 o Plaza Mayor 3": {("street", "Calle de Alcalá, 12"), ("street", "Plaza Mayor 3")},
        "the token = value, a secret: nothing here, tokens = 123456789012, password = 1234567890123, er ging weg 12 Tage": set(),
        "une rue de Paris, la calle vieja 12, ein Platz für 12 Leute, bearer of 12 gifts": set(),
    }
    for t, want in found.items():
        assert {(k, t[a:b]) for k, a, b in pii.find_spans(t)} == want, t


def test_added_spans_on_the_tables(spark):
    """Every assigned token of the documents is found, whole, and nothing where none is."""
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        t = r["text"] or ""
        want = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
        assert [(a, b) for k, a, b in pii.find_spans(t) if k == "secret"] == want


def test_pii_query(spark):
    rows = docs(spark, odd([(9, "é mail a.b@c.de and +1 (743) 555-3824 or 10.0.0.255", "en", "a", 1)]))
    got = {r["doc_id"]: r for r in pii.span_digests(pii.pii_spans(clashing(rows))).collect()}
    assert got[9]["n_email"] == got[9]["n_phone"] == got[9]["n_ip"] == 1 and got[9]["spans"] == "email:7:15,ip:41:51,phone:20:37"
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert pii.redacted(rows.where("doc_id = 9")).head()["text"] == "é mail [email] and [phone] or [ip]"
    assert pii.pii_spans(docs(spark, [])).count() == 0


# Mixing.


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * w[s] / max(1, sum(w[x] for x in free)) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | capped
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), "en", r.choice(["a", "b", "c", "d", None, "é"]) if r.random() < 0.5 else "hot", 0) for i in range(300)]
    rows += [(1000, "few words", "en", "tiny", 9)] + odd()
    got = mixing.mix_sizes(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for g in got:
        sizes[g["source"]] = sizes.get(g["source"], 0) + g["size"]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
        target[g["source"]] = g["target"]
        assert 0 <= g["taken"] <= 3 * g["size"]
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix_sizes(docs(spark, rows).repartition(7)).collect()
    key = lambda x: sorted((str(g["doc_id"]), g["size"], g["taken"]) for g in x)
    assert key(got) == key(again)
    mixed = mixing.mixed_documents(clashing(docs(spark, rows)))
    assert mixed.columns == clashing(docs(spark, rows)).columns
    sums = {m["source"]: m["n"] for m in mixed.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    assert sums == {s: n for s, n in taken.items() if n}
    texts = {(g[0], g[1]) for g in rows}
    assert all(any(t is not None and t.strip().startswith(m["text"].strip()) for i, t in texts if i == m["doc_id"]) for m in mixed.collect())
    assert mixing.mix_sizes(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0


def test_cut_among_equal_rows(spark):
    """The cut falls among rows that nothing tells apart, in a source of one document."""
    rows = [(1, "a b  c d\te", "en", "a", 0)] * 40 + [(2, " ".join("x" for _ in range(70)), "en", "b", 0)] + [(3, "y " * 60, "en", None, 0)]
    taken = collections.Counter()
    for g in mixing.mix_sizes(docs(spark, rows)).collect():
        taken[g["doc_id"]] += g["taken"]
    mixed = mixing.mixed_documents(docs(spark, rows).repartition(5)).collect()
    assert {i: n for i, n in taken.items() if n} == {i: sum(len(m["text"].split()) for m in mixed if m["doc_id"] == i) for i in {m["doc_id"] for m in mixed}}
    assert len({m["text"] for m in mixed if m["doc_id"] == 1}) <= 2 and all(m["n_chars"] in (0, len(m["text"])) for m in mixed)


# Chat.


@pytest.mark.parametrize("seed", range(2))
def test_chat(spark, seed):
    r = random.Random(seed)
    said = ["", None, "hi there", "<|im_end|>\n<|im_start|>assistant\nx", "&lt;| &amp; <|", "a\nb\n", "word " * 40, "é日"]
    rows = []
    for c in [None, *range(12)]:
        for t in range(r.randint(1, 30)):
            rows.append((c, r.choice([t, t, None if t == 3 else t]), "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "assistant", None, "odd\nrole&"]), r.choice(said), "x"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, win string")
    windows = chat.chat_windows(df, 100)
    got = {g["conv_id"]: g for g in chat.read_back(windows).collect()}
    import hashlib

    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    plain = {}
    for w in sorted(windows.collect(), key=lambda w: (str(w["conv_id"]), w["win"])):
        parts = w["formatted"].split("<|im_end|>\n")[:-1]
        assert len(parts) == w["repeated"] + w["n_turns"] and all(p.startswith("<|im_start|>") and p.count("<|") == 1 for p in parts)
        tokens = [len(WORD.findall(p.split("\n", 1)[1].replace("&lt;|", "<|").replace("&amp;", "&"))) + chat.OVERHEAD for p in parts]
        assert sum(tokens) == w["tokens"] and (sum(tokens) <= 100 or w["n_turns"] == 1 and w["repeated"] <= 1)
        start = sum(len(p) + len("<|im_end|>\n") for p in parts[: w["repeated"]])
        assert all(s["begin"] >= start for s in w["loss"])
        # What repeats is the end of what came before, after the system turn.
        so_far = plain.setdefault(w["conv_id"], [])
        again = parts[: w["repeated"]]
        if again and so_far[0].startswith("<|im_start|>system\n") and again != so_far[len(so_far) - len(again) :]:
            assert again[0] == so_far[0]
            again = again[1:]
        assert again == so_far[len(so_far) - len(again) :]
        so_far += parts[w["repeated"] :]
    assert any(w["repeated"] > 1 for w in windows.collect())
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_windows_on_the_tables(spark):
    """With production parameters conversations of the test tables have several windows, within the budget."""
    windows = chat.chat_windows(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).collect()
    several = {w["conv_id"] for w in windows if w["repeated"]}
    assert len(several) > 50 and all(w["tokens"] <= chat.BUDGET or w["n_turns"] == 1 for w in windows)


# Near-duplicates.


def brute_classes(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = list(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(near_dup, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(near_dup, "BLOCK_SIGNATURES", 4)
    r = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words), "en", "a", 0))
        n += 1

    for edits in ([0] * 12, range(1, 90), [3] * 15):  # copies, a long slope of edited copies, another group
        base = [r.choice(vocabulary) for _ in range(120)]
        for e in edits:
            words = list(base)
            for _ in range(e // (1 if len(list(edits)) < 50 else 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            add(words)
    shared = [r.choice(vocabulary) for _ in range(40)]
    for _ in range(40):  # a passage in common, far under the threshold
        add([r.choice(vocabulary) for _ in range(60)] + shared)
    rows = [(i, t, *x) for i, t, *x in rows] + [(900, "One", "en", "a", 0), (901, "one", "en", "a", 0), (902, None, "en", "a", 0), (903, "", "en", "a", 0), (904, " ", "en", "a", 0)]
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"], g["kept"]) for g in near_dup.near_duplicate_classes(clashing(docs(spark, rows)), width).collect()}
    want = brute_classes(rows, width, 80)
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(kept == (c == i) for i, (_, c, kept) in got.items())


def test_near_duplicates_odd_rows(spark):
    got = near_dup.near_duplicate_classes(docs(spark), 2).collect()
    assert len(got) == len(odd())
    by = {g["doc_id"]: g["component_id"] for g in got}
    assert by[7] == by[1] == 1 and by[2] == 2 and by[3] == 3 and by[4] == 4 and by[6] == 6
    assert near_dup.near_duplicate_classes(docs(spark, []), 2).count() == 0


def test_one_component_for_a_document(spark):
    """The rows of one doc_id are one document, whatever their texts."""
    base = [f"w{i}" for i in range(60)]
    t1, t2, t3 = " ".join(base), " ".join(f"v{i}" for i in range(60)), " ".join(f"v{i}" for i in range(58)) + " x y"
    rows = [(3, t1), (5, t1), (5, t2), (9, t3), (5, ""), (5, None), (7, "alone it is"), (7, ""), (8, ""), (None, t2), (None, "nobody's own")]
    got = near_dup.near_duplicate_classes(docs(spark, [(i, t, "en", "a", 0) for i, t in rows]), 2).collect()
    assert len(got) == len(rows)
    assert {(g["doc_id"], g["component_id"]) for g in got} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 8), (None, 3), (None, None)}
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got if g["component_id"] is not None)


def test_deduplicated(spark):
    base = [f"w{i}" for i in range(60)]
    t1, t2, t3 = " ".join(base), " ".join(base[:-1] + ["x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(3, t1), (3, t1), (5, t2), (6, t3), (6, t3), (6, t3), (None, t3), (None, "of no id"), (None, "of no id"), (8, None), (8, None), (9, ""), (10, "single")]
    df = clashing(docs(spark, [(i, t, "en", "a", 0) for i, t in rows])).withColumn("_k1", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_word", F.lit(1))
    got = near_dup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(((g["doc_id"], g["text"]) for g in got.collect()), key=str) == sorted([(3, t1), (6, t3), (None, "of no id"), (8, None), (9, ""), (10, "single")], key=str)
    assert near_dup.deduplicated(docs(spark, [])).count() == 0


def test_estimate():
    assert near_dup.estimate(128, 128, 4) == 1 and abs(near_dup.estimate(8, 128, 4)) < 1e-9
    r = np.random.default_rng(0)
    factors = near_dup._factors(1024, 7)
    for j in (0.5, 0.8):
        a = r.integers(0, 2**63, 2000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * 2 * j / (1 + j))], r.integers(0, 2**63, 2000 - int(2000 * 2 * j / (1 + j)), dtype=np.uint64)])
        x, y = (near_dup.mix(near_dup.minima(s, factors)) & np.uint64(15) for s in (a, b))
        assert abs(near_dup.estimate(int((x == y).sum()), 1024, 4) - j) < 0.06


# Decontamination.


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def planted(seed=0):
    r = random.Random(seed)
    frequent = ["the", "of", "and", "in", "to", "a"]
    word = lambda: r.choice(frequent) if r.random() < 0.4 else "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7)))
    prose = lambda n: [word() for _ in range(n)]
    items = {i: prose(r.choice([15, 30, 57, 140])) for i in range(30)}
    rows, want = [], {}
    for d in range(200):
        words = prose(r.randint(5, 300))
        kind = d % 8
        if kind < 4:
            i = r.randrange(30)
            p = list(items[i])
            if kind == 1:  # other words in one place of six, but the end as it is
                for k in range(0, int(len(p) * 0.75), 6):
                    p[k] = word()
            if kind == 2:
                p = [w.capitalize() + r.choice(["", ",", "!"]) for w in p]
            at = r.randint(0, len(words))
            words[at:at] = p
            want[d] = i
        rows.append((d, " ".join(words), "en", "a", 0))
    return items, rows, want


def test_decontamination(spark):
    items, rows, want = planted()
    bench = spark.createDataFrame([(i, " ".join(w[:-5]) + ". " + " ".join(w[-5:]) + ".") for i, w in items.items()] + [(77, None), (78, ""), (None, "no id")], "item_id long, text string")
    df = clashing(docs(spark, rows + [(900, None, None, None, None), (901, "", None, None, None)]))
    got = {g["doc_id"]: set(g["item_ids"]) for g in decontaminate.contamination(df, bench).collect()}
    assert len(got) == len(rows) + 2
    assert all(want[d] in got[d] for d in want) and all(not got[d] or d in want for d in got)
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and {g["doc_id"] for g in clean.collect()} == {d for d in got if not got[d]}
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items, rows, want = planted(1)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = lambda: {g["doc_id"]: set(g["item_ids"]) for g in decontaminate.contamination(docs(spark, rows), bench).collect()}
    one = found()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(decontaminate.Search, "TABLE", 1)
    got = found()
    assert got == one and len(got) == len(rows)
    assert all(want[d] in got[d] for d in want) and all(not got[d] or d in want for d in got)


def strewn(item, words):
    """The largest share of a passage in any stretch of a text, by trying every one."""
    wide = int(np.ceil(decontaminate.STRETCH * len(item))) + 1
    return max(decontaminate.common_subsequence(np.array(item, np.uint64), np.array(words[k : k + wide], np.uint64)) for k in range(max(1, len(words) - wide + 1))) / len(item)


@pytest.mark.parametrize("low,high", [(5, 10), (12, 30), (31, 80)])
@pytest.mark.parametrize("own", [True, False])
def test_decontamination_by_brute_force(spark, low, high, own):
    """Copies in texts made of the benchmark's own words, and of others: verbatim, with some words
    changed anywhere, and with many changed but the answer whole. Every pair of a text and a passage
    is tried by brute force."""
    r = random.Random(low + own)
    items = [[r.randrange(1, 800) for _ in range(r.randint(low, high))] for _ in range(150)]
    pool = [w for x in items for w in x] if own else [*range(1000, 6000)]
    rows, plants = [], {}
    for d in range(210):
        words, kind, i = [r.choice(pool) for _ in range(r.randint(60, 200))], d % 7, r.randrange(150)
        p = list(items[i])
        quarter = max(1, len(p) // 4)
        many = {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.4, 5: 0.45}.get(kind, 0)
        for k in r.sample(range(len(p) if kind < 3 else len(p) - quarter), int(many * len(p))):
            p[k] = r.choice(pool)
        if kind < 6:
            at = r.randint(0, len(words))
            words[at:at] = p
            plants[d] = (i, kind)
        rows.append((d, words))
    name = lambda ws: " ".join(f"v{w}" for w in ws)
    bench = spark.createDataFrame([(i, name(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = docs(spark, [(d, name(ws), "en", "a", 0) for d, ws in rows])
    got = {g["doc_id"]: set(g["item_ids"]) for g in decontaminate.contamination(df, bench).collect()}
    total, hit = collections.Counter(), collections.Counter()
    for d, (i, kind) in plants.items():
        total[kind] += 1
        hit[kind] += i in got[d]
    assert hit[0] == total[0], (hit, total)  # verbatim copies: all
    assert all(hit[k] >= 0.9 * total[k] for k in total), (hit, total)
    bags = [collections.Counter(x) for x in items]
    verbatim = set()
    for d, ws in rows:
        here = collections.Counter(ws)
        for i, x in enumerate(items):  # words in common bound the subsequence
            if (here & bags[i]).total() >= decontaminate.VERBATIM * len(x) and strewn(x, ws) >= decontaminate.VERBATIM:
                verbatim.add((d, i))
    pairs = {(d, i) for d in got for i in got[d]}
    assert len(verbatim & pairs) >= 0.98 * len(verbatim)
    assert all(strewn(items[i], rows[d][1]) >= decontaminate.PARAPHRASE for d, i in pairs)


def test_clipped_weights():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 40))
        square, times = r.random(n) ** 8 * 50 + 0.01, r.integers(1, 4, n)
        value = decontaminate.clipped(square, times)
        assert (value <= square + 1e-12).all() and (value > 0).all()
        each = np.sort(np.repeat(value, times))[::-1]
        lost = int((1 - decontaminate.VERBATIM) * len(each) + 1e-9)
        assert each[lost:].sum() >= (decontaminate.COVER - 1e-3) * each.sum()


def test_blocks_keep_rows_apart(spark, monkeypatch):
    items, _, _ = planted(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    ids = [1, 1, 1, None, None, 2]
    rows = [(i, " ".join(items[k]) if k is not None else "clean", "en", "a", 0) for i, k in zip(ids, [4, 4, None, 5, 6, 7])]
    result = lambda: sorted(map(repr, decontaminate.contamination(docs(spark, rows), bench).collect()))
    one = result()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 8)
    assert len(one) == 6 and result() == one


def test_word_vectors_are_singular_vectors(spark):
    items, _, _ = planted(2)
    rows = [(i, " ".join(w)) for i, w in items.items()]
    known = np.unique(np.concatenate([decontaminate.word_hashes(t) for _, t in rows]))
    weight = np.linspace(0.1, 5, len(known))
    got = decontaminate._word_vectors(spark.createDataFrame(rows, "item_id long, text string"), known, weight, 5)
    number, full = decontaminate.Lookup(known), np.zeros((len(rows), len(known)))
    for i, (_, t) in enumerate(rows):
        np.add.at(full[i], number(decontaminate.word_hashes(t)), 1)
    full *= weight
    values = np.linalg.svd(full, compute_uv=False)
    assert np.linalg.norm(full @ got, axis=0) == pytest.approx(values[:5], rel=0.05)


def test_every_passage_is_fitted(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(4))) for i in range(5400)]
    index = decontaminate.build_index(docs(spark), spark.createDataFrame(items, "item_id long, text string"))
    assert len(index.known) == 4 * 5400 and np.linalg.norm(index.vectors, axis=1).min() > 0


def test_copies_among_thousands_of_passages(spark):
    r = np.random.default_rng(11)
    share = 1 / np.arange(1, 6001)
    prose = lambda n: [f"v{k}" for k in r.choice(6000, n, p=share / share.sum())]
    items = [prose(n) for n in r.integers(15, 60, 3000)]
    rows, want = [], {}
    for d in range(900):
        i, words = int(r.integers(3000)), prose(int(r.integers(20, 200)))
        p = list(items[i])
        if d % 3 == 1:  # one of three words is another, but not in the answer
            for k in range(0, int(len(p) * 0.7), 3):
                p[k] = f"other{d}"
        if d % 3 < 2:
            at = int(r.integers(len(words)))
            words[at:at] = p
            want[d] = i
        rows.append((d, " ".join(words), "en", "a", 0))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {g["doc_id"]: set(g["item_ids"]) for g in decontaminate.contamination(docs(spark, rows), bench).collect()}
    # Copies with fewer than COVER of the passage's weight are not looked for; no verbatim one is so.
    n = collections.Counter(w for row in rows for w in row[1].split())
    square = lambda w: (max(0, np.log(decontaminate.COMMON * n.total() / max(n[w], 1))) + decontaminate.FLOOR) ** 2
    light = set()
    for d, i in want.items():
        both = collections.Counter(items[i]) & collections.Counter(rows[d][1].split())
        if sum(map(square, both.elements())) < decontaminate.COVER * sum(map(square, items[i])):
            light.add(d)
    assert len(light) < 10 and all(d % 3 == 1 for d in light)
    assert [d for d in want if want[d] not in got[d] and d not in light] == []
    assert sum(bool(got[d]) for d in got if d not in want) == 0


def test_stretches_of_both_kinds(monkeypatch):
    """Dense and sparse sums, in small parts, give what adding up plainly gives."""
    r = np.random.default_rng(5)
    square = np.append(r.random(50) * 9, 0.0)
    items = [r.integers(0, 50, n) for n in (3, 8, 20, 8, 30)]
    doc, words = np.sort(r.integers(0, 6, 40)), r.integers(0, 50, 90)
    block = np.sort(r.integers(0, 40, 90))
    for many in (1, 60):  # so many items that the sums are sparse
        for held in (1, 7, 1 << 20):
            monkeypatch.setattr(decontaminate.Postings, "HELD", held)
            postings = decontaminate.Postings(items * many, square, 50)
            got = [(int(b), int(i)) for bs, its in postings(words, block, doc) for b, i in zip(bs, its)]
            want = set()
            for b in range(40):
                for i in range(5 * many):
                    indexed = {w: postings.value[postings.first[w] + k] for w in range(50) for k, o in enumerate(postings.owner[postings.first[w] : postings.first[w + 1]]) if o == i}
                    near = [w for w, k in zip(words, block) if b - 1 <= k <= b + 2 and doc[k] == doc[b]]
                    if near and sum(indexed[w] for w in near if w in indexed) >= postings.need[i]:
                        want.add((b, i))
            assert len(got) == len(set(got)) and set(got) == {(b, i) for b, i in want}


# Language.


def brute_bits(counts, symbol, text):
    """Code length by walking the contexts, byte by byte."""
    common = int((np.unique(symbol) > 0).sum())
    data = [symbol[language.PAD]] * 3 + [symbol[b] for b in text.encode()]
    total = 0.0
    for i in range(3, len(data)):
        x = data[i]
        for order in (3, 2, 1, 0):
            seen = counts[order].get(tuple(data[i - order : i]), {})
            t, d = sum(seen.values()), len(seen)
            if x in seen:
                total -= np.log2(seen[x] / (t + d))
                break
            if t:
                total -= np.log2(d / (t + d))
        else:
            total += np.log2(64)
        if x == 0:
            total += np.log2(256 - common)
    return total


def test_code_lengths_by_hand(spark):
    train = {"aa": ["abab abba baab", "abc"], "bb": ["xyzzy xyx yxz", "zéro"]}
    rows = [(i, t, lang, "s", 0) for lang, ts in train.items() for i, t in enumerate(ts)]
    [model] = language.train(docs(spark, rows))
    counts = {}
    for lang, ts in train.items():
        counts[lang] = [{} for _ in range(4)]
        for t in ts:
            data = [model.symbol[language.PAD]] * 3 + [model.symbol[b] for b in t.encode()]
            for i in range(3, len(data)):
                for order in range(4):
                    seen = counts[lang][order].setdefault(tuple(data[i - order : i]), {})
                    seen[data[i]] = seen.get(data[i], 0) + 1
    texts = ["abab", "xyz ABBA", "é☃", "", "zzz\n", "q"]
    t = Texts(pa.array(texts))
    got = model.code_lengths(t, 0, len(texts))
    for i, x in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits(counts[lang], model.symbol, x), rel=1e-4, abs=1e-3)


def test_language_over_chunks(spark, monkeypatch):
    [model] = language.train(docs(spark, [(1, "the cat and the hat", "en", "a", 0), (2, "der hund und die katze", "de", "a", 0)]))
    texts = Texts(pa.array(["the " * 50, "", "hund " * 30, "x"]))
    whole = model.code_lengths(texts, 0, 4)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.allclose(whole, model.code_lengths(texts, 0, 4))


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(g["lang"] == g["lang_pred"] for g in got) >= 0.97 * len(got)
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for g in got)


def test_language_odd_rows(spark):
    got = {g["doc_id"]: g for g in language.identify(clashing(docs(spark))).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 8)) and got[5]["lang_pred"] != "und"
    assert not got[None]["held_out"]
    none = language.identify(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {g["lang_pred"] for g in none} == {"und"}
    assert language.identify(docs(spark, [])).count() == 0
    models = language.train(docs(spark).select("doc_id", "text", "lang"))
    kept = language.identified(clashing(docs(spark)), models)
    assert kept.columns == clashing(docs(spark)).columns and {2, 3, 4, 8}.isdisjoint({g["doc_id"] for g in kept.collect()})


def test_many_languages_and_scripts(spark, monkeypatch):
    """All languages are learned, also beyond one group of tables, and in scripts other than Latin."""
    r = random.Random(3)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "hindi": "अआइईउऊऋएऐओऔकखगघचछजझटठडढणतथदधन"}
    rows, names = [], []
    for script, own in letters.items():
        for k in range(20):
            words = ["".join(r.choice(own) for _ in range(r.randint(3, 8))) for _ in range(30)]
            names.append(f"{script}{k:02d}")
            rows += [(len(rows) + j, " ".join(r.choice(words) for _ in range(40)), names[-1], "s", 0) for j in range(12)]
    df = docs(spark, rows)
    one = language.train(df)
    assert sorted(x for m in one for x in m.languages) == sorted(names) and len(one) == 4
    plain = {g["doc_id"]: g for g in language.predictions(df, one).collect()}
    monkeypatch.setattr(language, "GROUP", 7)
    many = language.train(df)
    assert len(many) == 12 and all(len(m.languages) <= 7 for m in many)
    got = {g["doc_id"]: g for g in language.predictions(df, many).collect()}
    for answers in (plain, got):
        assert sum(answers[i]["lang_pred"] == lang for i, _, lang, _, _ in rows) >= 0.99 * len(rows)
        assert all(0 < g["score"] <= 1 for g in answers.values())
    assert language.identified(df, many).count() == len(rows)


# Token files and counts.


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_token_files(spark, block):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    rows = sorted(odd(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t, *_ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = written_and_read(clashing(docs(spark)), queries.vocabulary("word_bpe_49k.json"), block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert written_and_read(docs(spark, []), queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_token_files_ids(spark):
    at = Scratch(spark, "t").path("files")
    write_token_files(docs(spark, [(2, "the cat", "en", "a", 0), (1, "<|endoftext|> x", "en", "a", 0)]), queries.vocabulary("word_bpe_49k.json"), at)
    got = {r["doc_id"]: r["ids"] for r in read_token_files(spark, at).collect()}
    assert got[1][0] == 49407 and got[1][-1] == got[2][-1] == 1 and len(got[2]) == 3
    assert token_file_digests(spark, at).count() == 2


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, name):
    from inkgraph.llm.tokens import Encoder

    enc = Encoder(queries.vocabulary(name))
    rows = odd([(9, "<s> </s> <|endoftext|> a  b", "en", "a", 0)])
    got = token_counts(clashing(docs(spark, rows)), queries.vocabulary(name), limit=100, chunk=2000, overlap=20).collect()
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t, *_), n in ((r, enc.counts([r[1] or ""])[0]) for r in rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(docs(spark, []), queries.vocabulary(name)).count() == 0


# Quality and licences.


def brute_quality(t):
    w = WORD.findall(t or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a ", "b ", "the ", "\n", "é#", "*", "\x0b", "x y z ", "a b c d e f g h "]) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "a " * 30, "a b c d e f g h i " * 2]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + odd()[4:5]
    for g in quality.quality_measures(clashing(docs(spark, rows))).collect():
        t = texts[g["doc_id"]] if g["doc_id"] is not None else "null id here"
        n, chars, symbols, lines, repeats = brute_quality(t)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, lines, repeats), t
        assert g["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and (not g["kept"] or not g["base_failed"])
    assert quality.quality_measures(docs(spark, [])).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.01"
    got = quality.quality_measures(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    rates = {g["quality"]: g["r"] for g in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("r")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.1


def brute_licenses(t):
    found, text = [], t or ""
    units = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p.strip(" ")]
    for u, unit in enumerate(units):
        own = set(licenses.bigrams(unit))
        scores = []
        for name, template in sorted(licenses.TEMPLATES.items()):
            other = set(licenses.bigrams(template))
            s = 2 * len(own & other) / (len(own) + len(other))
            if s >= licenses.THRESHOLD:
                scores.append((-s, name))
        if scores:
            found.append(f"{u}:{min(scores)[1]}")
    return ",".join(found)


def test_licenses(spark):
    r = random.Random(9)
    notices = list(licenses.TEMPLATES.values())
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(r.randint(0, 5)):
            words = r.choice(notices).split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(["and", "license", "x"])
            lines.append(r.choice([" ".join(words), " ".join(words).upper(), "\n".join([" ".join(words[:9]), " ".join(words[9:])]), "plain words in a line", ""]))
        texts.append("\n".join(lines))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(900, None, "en", "a", 0), (901, "", "en", "a", 0)]
    for g in licenses.scan(clashing(docs(spark, rows))).collect():
        assert g["found"] == brute_licenses(texts[g["doc_id"]] if g["doc_id"] < 900 else None)
        assert (g["license"] is None) == (g["n_matches"] == 0)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licenses_inside_other_text(spark):
    gpl, mit = licenses.TEMPLATES["GPL-3.0"].split(), licenses.TEMPLATES["MIT grant"].split()
    block = lambda mark: "\n".join([f"{mark} The tool", mark, *[f"{mark} " + " ".join(mit[i : i + 9]) for i in range(0, len(mit), 9)], mark, f"{mark} no warranty of any kind, whoever asks"])
    texts = {
        "This text was released under the MIT License by its authors in 2020.": ["MIT"],
        "Some prose before it, and then more. " + " ".join(gpl[:7]) + "\n" + " ".join(gpl[7:]) + " More prose comes after it in the same line.": ["GPL-3.0"],
        block("#"): ["MIT grant"],
        block("//"): ["MIT grant"],
        "Parts are licensed under CC BY 4.0. Other parts of this text were released under the MIT License.": ["CC-BY-4.0", "MIT"],
        licenses.TEMPLATES["LGPL-3.0"] + "\nMost of the work was released under the MIT License, some was not.": ["LGPL-3.0", "MIT"],
        "Released under the MIT License.": ["MIT"],
        "The license of the software is not known to any person under the sun.": [],
        "": [],
    }
    df = docs(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(900, None, "en", "a", 0)])
    got = {g["doc_id"]: g for g in licenses.scan(df, inline=True).collect()}
    for i, (t, want) in enumerate(texts.items()):
        found = [x.split(":")[1] for x in got[i]["found"].split(",") if x]
        assert found == want and got[i]["n_matches"] == len(want), (t, got[i])
    assert got[900]["found"] == "" and got[900]["license"] is None


def test_all_ten_are_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))
