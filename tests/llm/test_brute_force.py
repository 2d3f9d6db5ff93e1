"""The corpus operators against plain Python: all pairs, all windows, all label sequences; and their odd rows."""

import html
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import bagminhash, exact_dedup, html_extract, license_scan, mixing, near_dedup, packing, secret_scan, tokens, topk, toxicity

DATA = "/root/testdata"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, key string"
BIG = 10**18


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").cache()


# op 1

P = [f"<p>Paragraph {i} speaks at some length about its subject, the causes and what came of it in the years after.</p>" for i in range(12)]


def plain(x):
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())


def test_html_marks_are_no_removal():
    text = "".join(P)
    for mark in ("class='entry form-factor'", "class=legal", "class='alert share'", "class='widget rail'", "id=search", "class=xq1"):
        page = f"<body><nav><a href=a>x</a></nav><div class=menu><a href=a>A</a> <a href=b>B</a></div><div {mark}>{text}</div><div class=ad>Buy now, it is cheap.</div></body>"
        assert html_extract.main_text(page) == plain(text), mark


def test_html_comments_and_gaps():
    text = "<h1>Head</h1>" + "".join(P[:6])
    remarks = "<div class=b7><div><b>Ann</b><span>3 May</span><p>Great post, thanks!</p></div><div><b>Bob</b><span>4 May</span><p>I do not agree at all.</p></div></div>"
    assert html_extract.main_text(f"<body><div class=a1>{text}</div>{remarks}</body>") == plain(text)
    long = "<h3>3 Comments</h3><div><p>" + "A long remark of a reader follows here. " * 5 + "</p></div>"
    assert html_extract.main_text(f"<body><div class=a1>{text}{long}</div></body>") == plain(text)
    parts = f"<div><h2>A</h2>{''.join(P[:5])}</div><div><h2>B</h2><p>Short.</p></div><div><h2>C</h2>{''.join(P[5:8])}</div>"
    assert html_extract.main_text(f"<body><div><h1>H</h1>{parts}</div></body>") == "H " + plain(parts)


def pages():
    rng = random.Random(4)
    for _ in range(60):
        blocks = []
        for k in range(rng.randint(2, 5)):
            inner = "".join(f"<p>{' '.join(rng.choice(['word', 'longer', 'text', 'of']) for _ in range(rng.choice([2, 30, 60])))} {k}{j}</p>" for j in range(rng.randint(1, 4)))
            blocks.append(f"<div>{inner}</div>" if rng.random() < 0.7 else f"<div><a href=a>link {k}</a> <a href=b>other</a></div>")
        yield f"<body>{''.join(blocks)}</body>"


def test_html_density_by_hand():
    def shape(n):
        """(characters, of them in links, tags, of them links), the plain way: from all descendants."""
        chars = links = tags = link_tags = 0
        stack = [(n, n.tag == "a")]
        while stack:
            x, inside = stack.pop()
            for y in x.parts:
                if isinstance(y, str):
                    size = len(re.sub(r"\s", "", y))
                    chars, links = chars + size, links + size * inside
                elif not (y.noise or y.doubted):
                    tags, link_tags = tags + (y.tag not in html_extract.VOID), link_tags + (y.tag == "a")
                    stack.append((y, inside or y.tag == "a"))
        return chars, links, tags, link_tags

    for page in pages():
        root = html_extract.parse(page)
        html_extract.measure(root)
        for n in html_extract.densities(root):
            c, lc, t, lt = shape(n)
            want = (c - lc) / (t - lt + 1) * (c - lc) / c * (html_extract.PRIOR if n.doubted else 1) if c else 0
            assert math.isclose(n.density, want)
            own = sum(len(re.sub(r"\s", "", x)) for x in n.parts if isinstance(x, str)) * (html_extract.PRIOR if n.doubted else 1)
            assert math.isclose(n.total, own + sum(x.density for x in n.parts if not isinstance(x, str)))


def test_html_density_decides(monkeypatch):
    held = list(pages())
    want = [html_extract.main_text(p) for p in held]
    rng, own = random.Random(1), html_extract.density
    monkeypatch.setattr(html_extract, "density", lambda n: own(n) and rng.uniform(1, 100))
    assert sum(html_extract.main_text(p) != w for p, w in zip(held, want)) > len(held) // 4


def test_html_table(spark):
    page = f"<article>{P[0]}</article>"
    rows = [(1, "u", page, 9, "t"), (1, "u", page, 9, "t"), (2, None, None, 9, "t"), (None, "u", "", 9, "t"), (3, "u", f"<article>{P[0] * 3000}</article>", 9, "t"), (4, "u", "<div>" * 5000 + "deep", 9, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_extract.extract(table).collect()
    assert Counter((r["page_id"], r["url"], r["n_chars"]) for r in got) == Counter([(1, "u", len(plain(P[0])))] * 2 + [(2, None, 0), (None, "u", 0), (3, "u", 3000 * len(plain(P[0])) + 2999), (4, "u", 4)])
    assert html_extract.extract(table.where("false")).count() == 0


def test_html_of_the_corpus(spark):
    for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r["html"] or "", re.S)
        want = plain(re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", inner[1])) if inner else ""
        assert html_extract.main_text(r["html"]) == want


# op 2


def classes(texts):
    """Components of all pairs with a weighted Jaccard similarity of 0.8 or more, by exact counts."""
    bags = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        bags.append(Counter(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    of, links = defaultdict(list), 0
    for i, bag in enumerate(bags):
        met = Counter()
        for s, n in bag.items():
            for j, m in of[s]:
                met[j] += min(n, m)
            of[s].append((i, n))
        if not bag:
            met = Counter({j: 0 for j in range(i) if not bags[j]})
        for j, both in met.items():
            most = bag.total() + bags[j].total() - both
            if not most or both / most >= 0.8:
                links += 1
                label[root(i)] = root(j)
    return [root(i) for i in range(len(texts))], links


def test_near_equals_all_pairs(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    label, links = classes([r["text"] for r in rows])
    assert links > 50
    first = {}
    for r, x in zip(rows, label):
        first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    got = near_dedup.near_query(corpus).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(r["doc_id"], first[x]) for r, x in zip(rows, label)}


def test_near_recall_at_the_threshold():
    """Pairs just at 0.8 share a bucket and pass the signature filter."""
    rng, lost, n = random.Random(2), 0, 0
    for _ in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        b = list(a)
        for at in rng.sample(range(0, 396, 11), 8):
            b[at] = "new"
        x, y = " ".join(a), " ".join(b)
        if bagminhash.similarity(bagminhash.multiset(x), bagminhash.multiset(y)) < 0.8:
            continue
        n += 1
        hashes, counts, _ = bagminhash.shingles([x, y])
        s = bagminhash.signatures(hashes, counts, near_dedup.REGISTERS)
        keys = bagminhash.bands(s[:, : near_dedup.BANDS * near_dedup.ROWS], near_dedup.BANDS, near_dedup.ROWS)
        est = near_dedup.agreement(s[0].astype(np.uint8), s[1].astype(np.uint8))
        lost += not (keys[0] == keys[1]).any() or est < near_dedup.LEAST
    assert n > 40 and not lost


def test_near_hot_groups(spark):
    """One group of exact and one of near copies, each with a third of the rows."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    base, copy = words(120), " ".join(words(90))
    rows = [(i, " ".join(words(40)), "s") for i in range(150)] + [(200 + i, copy, "s") for i in range(150)]
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((400 + i, " ".join(w), "s"))
    table = docs(spark, rows)
    size = Counter(r["class_id"] for r in near_dedup.near_query(table).collect())
    assert size[200] == 150 and size[400] == 150 and len(size) == 152
    assert near_dedup.keep_one(table).count() == 152


@pytest.mark.parametrize("few", [0, 300, near_dedup.FEW_EDGES])
def test_near_components(spark, monkeypatch, few):
    """A long path and a random graph; what is left for one task takes no more queries, whatever its shape."""
    made, keep = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: made.append(name) or keep(df, name))
    monkeypatch.setattr(near_dedup, "FEW_EDGES", few)
    rng = random.Random(4)
    names = [rng.randrange(-BIG, BIG) for _ in range(1500)]
    edges = [(names[i], names[i + 1]) for i in range(500)] + [(rng.choice(names[600:]), rng.choice(names[600:])) for _ in range(400)]
    above = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and above[a] is not above[b]:
            above[a] |= above[b]
            for x in above[b]:
                above[x] = above[a]
    rows = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["label"]].add(r["node"])
    assert len(rows) == len(above) and {frozenset(x) for x in got.values()} == {frozenset(x) for x in above.values()}
    assert all(label in x for label, x in got.items())
    assert len(made) == 3 or few < len(edges)


# op 3


def filled(template):
    return template.replace("{holder}", "2011-2020 Foo Bar Ltd.").replace("{}", "2.0")


def test_license_all_pairs_of_templates():
    scan = license_scan.Scanner().scan
    names = lambda text: [x[2].split(":")[0] for x in scan(text)]
    for name, text in license_scan.TEMPLATES:
        assert [(x[2].split(":")[0], x[4]) for x in scan(f"Some words here.\n\n{filled(text)}\n\nMore words.")] == [(name, [])]
    for (a, x), (b, y) in itertools.product(license_scan.TEMPLATES, repeat=2):
        assert names(f"{filled(x)}\n\n{filled(y)}") == [a, b]


def test_license_wording(tmp_path):
    name, text = next(x for x in license_scan.TEMPLATES if x[0] == "MIT")
    (found,) = license_scan.Scanner().scan(text.replace("MERCHANTABILITY", "USEFULNESS"))
    assert found[2] == "MIT" and found[4] == ["merchantability"] and found[5] == ["usefulness"]
    (tmp_path / "House").write_text("You may read this {text} aloud on Sundays under this license, but only to people who ask you for it twice.")
    scanner = license_scan.Scanner((*license_scan.TEMPLATES, *license_scan.templates_in(str(tmp_path))))
    assert [x[2] for x in scanner.scan("x. You may read this (text) aloud on Sundays under this license, but only to people who ask you for it twice.")] == ["House"]


def test_license_table(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice, "s"), (1, notice, "s"), (2, None, "s"), (3, "", "s"), (None, notice, "s"), (4, "word " * 50000 + notice + " " + notice, "s")]
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["start"]) for r in got) == Counter([(1, 0), (1, 0), (None, 0), (4, 250000), (4, 250032)])


# op 4


def test_packing_is_near_the_bound(spark, corpus):
    out = packing.pack(corpus).agg(F.sum("length").alias("ids"), F.countDistinct("sequence_id").alias("n")).first()
    assert out["n"] <= 1.01 * math.ceil(out["ids"] / packing.CAPACITY)
    rng = random.Random(5)
    for _ in range(300):  # one bin: the fullest sum that holds the longest length
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        bag = [x for x, n in counts.items() for _ in range(n)]
        bag.remove(max(bag))
        best = max(sum(c) for k in range(len(bag) + 1) for c in itertools.combinations(bag, k) if sum(c) <= 100 - max(counts))
        got = packing.fullest(counts, 100)
        assert sum(x * n for x, n in got.items()) == best + max(counts) and all(n <= counts[x] for x, n in got.items())


# op 5

VALUE = re.compile(secret_scan.ASSIGN_VALUE, re.A)


def secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in VALUE.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
    for rank, (kind, pattern, least) in enumerate(secret_scan.CLASSES, 3):
        new = []
        for m in re.finditer(pattern, text, re.A):
            if any(a <= m.start() and b >= m.end() for a, _, b, _ in out) or any(re.search(p, m[0], re.A) for p in secret_scan.ALLOWED):
                continue
            n = secret_scan.WINDOW
            high = [i for i in range(len(m[0]) - n + 1) if -sum(c / n * math.log2(c / n) for c in Counter(m[0][i : i + n]).values()) >= least - 1e-9]
            if high:
                new.append((m.start() + high[0], rank, m.start() + high[-1] + n, kind))
        out += new
    return base, ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_equal_plain_windows(spark, corpus):
    import hashlib

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    token = lambda: rng.choice([
        "word", "é", "".join(rng.choices(letters, k=rng.randint(18, 44))), "".join(rng.choices("0123456789ABCDEFabcdef", k=rng.randint(14, 40))), "".join(rng.choices("0123456789abcdef", k=20)),
        "aaaa1aaaa1aaaa1aaaa1aaaa1", "AKIA" + "".join(rng.choices("ABCDEFGH0123", k=rng.randint(10, 20))), f"api_key='{''.join(rng.choices(letters, k=rng.randint(8, 30)))}'", "123e4567-e89b-12d3-a456-426614174000", "changeme1234567890abcdefXYZ",
    ])
    made = [(BIG + i, " ".join(token() for _ in range(rng.randint(1, 40))), "s") for i in range(150)] + [(1, " ".join(token() for _ in range(3000)), "s"), (2, None, "s"), (3, "", "s")]
    made += [made[0]]
    table = docs(spark, made).select("doc_id", "text").union(corpus.select("doc_id", "text"))
    rows = [(r["doc_id"], secrets(r["text"] or "")) for r in table.collect()]
    want = Counter((i, hashlib.sha256(base.encode()).hexdigest(), spans) for i, (base, spans) in rows)
    assert sum("entropy" in spans for _, (_, spans) in rows) > 80
    assert Counter((r["doc_id"], r["base_sha256"], r["spans"]) for r in secret_scan.scan_query(table).collect()) == want
    assert secret_scan.scan_query(docs(spark, made)).count() == len(made)


# op 6


def test_mixing_targets_and_totals(spark, corpus):
    rows = corpus.select("source", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("n")).groupBy("source").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    sizes = {r["source"]: r["n"] for r in rows}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2 * sizes[s] for s in sizes}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(cap[s]) for s in full}
        left, open_ = left - sum(cap[s] for s in full), open_ - full
    got = mixing.mix(corpus)
    for r in got.groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("n"), F.sum("taken").alias("taken")).collect():
        assert math.isclose(r["t"], target[r["source"]], rel_tol=1e-9) and r["n"] == sizes[r["source"]] and abs(r["taken"] - r["t"]) <= 0.01 * r["t"]
    want = got.groupBy("source").agg(F.sum("copies").alias("n"), F.sum("taken").alias("words"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD))
    assert sorted(map(tuple, mixing.mixed(corpus).groupBy("source").agg(F.count("*"), F.sum(words)).collect()), key=str) == sorted(((r["source"], r["n"], r["words"]) for r in want.collect()), key=str)


def test_mixing_one_id_in_many_sources(spark):
    table = docs(spark, [(i, f"w{i} " * 10, s) for s in ("s0", "s1", "s2") for i in range(200)])
    taken = {r["source"]: r["n"] for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert abs(taken["s0"] - 4000) <= 10 and abs(taken["s1"] - 10000 / 3) <= 10 and abs(taken["s2"] - 5000 / 3) <= 10
    assert {r["source"]: 10 * r["count"] for r in mixing.mixed(table).groupBy("source").count().collect()} == taken


def test_mixing_ids_and_repeated_rows(spark):
    rows = [(BIG + 1, "a b c", "s"), (BIG + 3, "a b c d", "s"), (None, "q r s t u", "s"), (None, None, None), (7, "", "t")] + [(5, "same text", "s")] * 90 + [(5, "same text", None)] * 20 + [(5, "other text", "s")]
    table = docs(spark, rows)
    got = mixing.mix_query(table)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _, _ in rows)
    copies = Counter()
    for r in mixing.mix(table).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixing.mixed(table).collect())
    assert out == +copies


# op 8


def test_toxicity_marginals_by_enumeration():
    rng = random.Random(7)
    for _ in range(30):
        model = toxicity.Model({"=bad": rng.uniform(1, 4), "=odd": rng.uniform(-2, 2)}, rng.uniform(-3, 1), tuple(rng.uniform(-1, 1) for _ in range(3)))
        words = [rng.choice(["bad", "odd", "plain", "word"]) for _ in range(rng.randint(1, 9))]
        tagger = toxicity.Tagger(model)
        n, at, got = tagger.read(" ".join(words))
        change = {(0, 0): 0.0, (0, 1): model.change[0], (1, 0): model.change[1], (1, 1): model.change[2]}
        weight, total = np.zeros(len(words)), 0.0
        for tags in itertools.product((0, 1), repeat=len(words)):
            score = sum(y * (model.bias + model.weights.get(f"={w}", 0.0)) for w, y in zip(words, tags)) + sum(change[x] for x in zip(tags, tags[1:]))
            # the first token has a change into it like any other, from either state alike
            p = math.exp(score) * (math.exp(change[0, tags[0]]) + math.exp(change[1, tags[0]]))
            weight, total = weight + p * np.array(tags), total + p
        assert n == len(words) and np.allclose(got, (weight / total)[at])
        emit = np.array([[model.bias + model.weights.get(f"={w}", 0.0) for w in words]])
        assert np.allclose(toxicity._forward_backward(emit, np.array([len(words)]), np.array(model.change))[0][0], weight / total)


def test_toxicity_rows(spark):
    toxic = lambda i: i % 3 == 0
    rows = [(i, f"people {i} walk home" + (" you vilegrub stinkpot" if toxic(i) else " in the rain"), "s") for i in range(120)]
    table = docs(spark, rows + [(900, None, "s"), (901, "", "s"), (902, "vilegrub " * 40000, "s"), (None, "calm words", "s"), (0, rows[0][1], "s")])
    labels = spark.createDataFrame([(i, 0, int(toxic(i)), "t") for i in range(120)] + [(0, 0, 1, "t"), (1, 1, None, "t"), (None, 1, 1, "t")], "doc_id long, quality long, toxic long, text string")
    got = toxicity.score_query(table, labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 125 and all(0 <= r["score"] <= 1 for r in got)
    assert all(by[i]["predicted"] == toxic(i) for i in range(120)) and by[902]["predicted"] == 1 and by[900]["score"] == by[901]["score"] and by[900]["predicted"] == 0
    assert toxicity.score_query(table.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.score_query(table, labels.where("false")).collect()} == {0.0}
    kept = toxicity.without_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == 80 + 3
    assert len(toxicity.training_rows(table, labels, most_bytes=600)) < 40


# op 9


@pytest.mark.parametrize("max_bits", [64, exact_dedup.MAX_BITS])
def test_exact_hot_group(spark, max_bits):
    rows = [(i, f"text {i}", "s") for i in range(900)] + [(1000 + i, "Hot TEXT" if i % 2 else "hot text", "s") for i in range(500)]
    got = exact_dedup.exact_dedup(docs(spark, rows), max_bits=max_bits).collect()
    assert Counter(r["group_size"] for r in got) == {1: 900, 500: 500} and {r["keep_id"] for r in got if r["group_size"] > 1} == {1499}
    assert sum(r["kept"] for r in got) == 901


# op 10


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=40).round(1).tolist(), 0, "x") for i in range(200)] + [(20, rng.normal(size=40).tolist(), 0, "x"), (41, [1.0] * 40, 0, "x"), (42, [1.0] * 40, 0, "x"), (40, [0.5] * 7, 0, "x"), (43, [0.25] * 7, 0, "x"), (60, [], 0, "x"), (None, [1.0] * 40, 0, "x"), (80, None, 0, "x"), (81, [1.0, None] * 20, 0, "x"), (100, [float("inf")] * 40, 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int, score string")
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ c), i) for i, c in good if i != q and len(c) == len(v))[:20]
            want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    for kind in ({}, {"cell": 32, "queries": 4, "pilot": 25}):
        assert Counter(map(tuple, topk.top_k(table, **kind).collect())) == want


def test_topk_blocks():
    rng = np.random.default_rng(9)
    c = rng.integers(-90, 90, (700, 33)).astype(float)
    c[:200] *= 3  # few candidates matter, so pairs are listed
    q, ids = c[:50], np.arange(700)
    least = topk.floors(q, c[:100], ids[:50], ids[:100], 5)
    for start in (None, least):
        rows, found, score = topk.search_block(q, c, ids[:50], ids, 5, 8, start, step=64)
        for i in range(50):
            want = sorted((-int(q[i] @ c[j]), j) for j in range(700) if j != i)[:5]
            assert [(-s, j) for s, j in zip(score[rows == i], found[rows == i])] == want


# pipeline


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(["sun", "moon", "star", "sky", "sea", "land", "wind", "rain"]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, text(30), f"s{i % 3}") for i in range(40)] + [(50, None, None), (51, "", "s1"), (52, None, "s1"), (None, text(20), "s2"), (3, text(25), "s2"), (60, text(3000), "s0")]
    rows += [rows[0], (70, rows[1][1], "s2"), (71, rows[2][1] + " more", "s1")]
    table = docs(spark, rows)
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    for held, empty in ((table, False), (table.where("false"), True)):
        at = held
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == held.columns
            path = f"{tmp_path}/{name}-{empty}"
            out.write.parquet(path)
            at = spark.read.parquet(path)
            if name == "near_dedup" and not empty:
                # of the empty texts one, of equal ones one, of 25 words with one more one
                assert at.count() == len(rows) - 2 - 1 - 1 - 1 and at.where("doc_id is null").count() == 1
        assert (at.count() == 0) == empty


def dense_marginals(model, text):
    """The number of a document's tokens, and the marginals of those with a feature, from a forward-backward
    pass over every token, nothing skipped."""
    words, (a, b, c) = re.findall(r"\w+", text), map(math.exp, model.change)
    known = [[model.weights[f] for f in (f"={w}", *(w[:n] for n in range(3, 7) if len(w) >= n)) if f in model.weights] for w in map(str.lower, words)]
    emit = [math.exp(model.bias + sum(x)) for x in known]
    ahead, x, y = [], 1.0, 1.0
    for e in emit:
        x, y = x + y * b, (x * a + y * c) * e
        x, y = x / (x + y), y / (x + y)
        ahead.append(y)
    u, v, marginal = 1.0, 1.0, []
    for e, y in zip(reversed(emit), reversed(ahead)):
        marginal.append(y * v / ((1 - y) * u + y * v))
        u, v = u + a * e * v, b * u + c * e * v
        u, v = u / (u + v), v / (u + v)
    return len(words), [x for x, of in zip(reversed(marginal), known) if of]


def targets_by_hand(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    while open_ := [s for s in order if s not in target]:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(2 * size[s] for s in full)
    return target


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, of the documents of sf0.001 and of planted rows."""
    import corpus_pipeline

    at, rng = str(tmp_path_factory.mktemp("stages")), random.Random(12)
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    # words of their own: those of the table hold insults
    vocabulary = ["".join(x) for x in itertools.product(("bar", "kel", "mod", "nur", "pif", "sot"), ("ab", "en", "il", "or"), ("", "ta", "wu"))]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rude = lambda: " ".join([*text(40).split(), "vilegrub", "stinkpot", *text(20).split()])
    base, rows = [text(120) for _ in range(6)], []
    for k, x in enumerate(base):
        words = x.split()
        words[60] = "othered"
        rows += [(9000 + 10 * k, x), (9001 + 10 * k, x.upper()), (9002 + 10 * k, " ".join(words)), (9003 + 10 * k, " ".join(words[:115])), (9004 + 10 * k, " ".join(words[::-1]))]
    rows += [(9500 + k, rude()) for k in range(60)] + [(9600 + k, text(60)) for k in range(60)]
    marks = [(9500 + k, 0, 1) for k in range(40)] + [(9600 + k, 1, 0) for k in range(60)]
    rows += [(9700, None), (9701, ""), (9702, text(5000)), (9703, "x" * 9000)]
    added = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"planted{i % 3}", len(t or "")) for i, t in rows], table.schema)
    table.union(added).write.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    labels.union(spark.createDataFrame(marks, labels.schema)).write.parquet(f"{at}/labels.parquet")
    held = [spark.read.parquet(f"{at}/documents.parquet")]
    original = corpus_pipeline.stored

    def watched(df, name):
        held.append(original(df, name))
        return held[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "stored", watched)
        last = corpus_pipeline.run(spark, at)
    assert last is held[-1] and len(held) == len(corpus_pipeline.STAGES) + 1
    names = [name for name, _ in corpus_pipeline.STAGES]
    return spark.read.parquet(f"{at}/labels.parquet"), {name: (a, b) for name, a, b in zip(names, held, held[1:])}


def whole(df):
    return Counter(map(tuple, df.collect()))


def test_pipeline_toxicity(stages):
    labels, of = stages
    docs_, out = of["toxicity"]
    model = toxicity.fit(docs_, labels)
    want = Counter()
    learnt = {r["doc_id"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    texts = {r["doc_id"]: r["text"] or "" for r in docs_.collect()}
    assert sorted(t for t, _ in toxicity.training_rows(docs_, labels)) == sorted(texts[i] for i in learnt)
    for r in docs_.collect():
        n, m = dense_marginals(model, r["text"] or "")
        z = sum(w * x for w, x in zip(model.document, (1.0, math.log1p(sum(m)), max(m, default=0.0), 10 * sum(m) / max(1, n))))
        want[tuple(r)] += 1 / (1 + math.exp(-z)) < toxicity.CUT
    assert whole(out) == +want
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & set(range(9500, 9560)) and set(range(9600, 9660)) <= kept and 9700 in kept


def test_pipeline_exact(stages):
    docs_, out = stages[1]["exact_dedup"]
    stays = {}
    for r in docs_.collect():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        stays[key] = max(stays.get(key, r), r, key=lambda r: r["doc_id"])
    assert whole(out) == Counter(map(tuple, stays.values())) and len(stays) < docs_.count()


def test_pipeline_near(stages):
    docs_, out = stages[1]["near_dedup"]
    rows = sorted(docs_.collect(), key=lambda r: r["doc_id"])
    label, _ = classes([r["text"] for r in rows])
    first = {}
    for r, x in zip(rows, label):
        first.setdefault(x, r)
    assert whole(out) == Counter(map(tuple, first.values())) and len(first) < len(rows) - 6


def test_pipeline_mixing(stages):
    docs_, out = stages[1]["mixing"]
    rows, got = docs_.collect(), whole(out)
    words = {tuple(r): len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for r in rows}
    size, docs_of = Counter(), Counter()
    for r in rows:
        size[r["source"]] += words[tuple(r)]
        docs_of[r["source"]] += 1
    target = targets_by_hand(size)
    taken, copies = Counter(), Counter()
    assert set(got) <= set(words)
    for r in rows:
        n, f = got[tuple(r)], target[r["source"]] / size[r["source"]] if size[r["source"]] else 0.0
        assert math.floor(f + 1e-9) <= n <= math.ceil(f - 1e-9)
        taken[r["source"]] += n * words[tuple(r)]
        copies[r["source"]] += n
    for s in size:
        most = max(words[tuple(r)] for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s]) <= most / 2 + 1 and abs(copies[s] - docs_of[s] * target[s] / max(1, size[s])) <= mixing.LANDING + 2


def test_pipeline_packing(stages):
    from tokenizers import Tokenizer

    docs_, out = stages[1]["packing"]
    lib, want, lengths = Tokenizer.from_file(tokens.default_path()), Counter(), []
    for r in docs_.collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends, bins = defaultdict(int), []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024
    for x in sorted(lengths, reverse=True):  # best fit, longest first, the plain way
        open_ = [k for k, room in enumerate(bins) if room >= x]
        best = min(open_, key=bins.__getitem__, default=None)
        if best is None:
            bins.append(1024 - x)
        else:
            bins[best] -= x
    assert math.ceil(sum(lengths) / 1024) <= len(ends) <= len(bins)
