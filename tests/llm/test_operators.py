"""The operators against brute force and on awkward input: nulls, empty tables, ties, repeats, long texts, clashing columns."""

import random
import re
from collections import defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import answer_defects, leakage, near_duplicates, packing, queries, residue, site_lines, splitting, survivors
from tallyloom.session import read_table

W = re.compile(r"[^\W_]+")
CHUNK = "id string, paper_id string, ticker string, file_type string, page_number int, word_count int, is_table boolean, content string"


def chunks(spark, rows, extra=False):
    df = spark.createDataFrame([(i, p, t, f, 1, None, False, c) for i, p, t, f, c in rows], CHUNK)
    return df.withColumns({k: F.lit("x") for k in ("anchors", "pos", "line", "c1", "piece_no", "text", "k1")}) if extra else df


def grams(t, n=3):
    w = W.findall((t or "").lower())
    return set(zip(*(w[i:] for i in range(n))))


def near_pairs(rows):
    g = {i: grams(c) for i, c in rows}
    ids = sorted(i for i in g if g[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(g[a] & g[b]) >= len(g[a] | g[b])}


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocab) for _ in range(90)]
        rows.append((f"a{k:02}", " ".join(base)))
        for v in range(rng.randrange(4)):
            t = list(base)
            for _ in range(3):
                t[rng.randrange(90)] = rng.choice(vocab)
            rows.append((f"b{k:02}_{v}", " ".join(t)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper() + " ."), ("n1", None), ("n2", ""), ("n3", "two words"), ("long", "x y z " * 30_000)]
    return rows


def test_p1_matches_brute_force(spark, edited):
    df = chunks(spark, [(i, "p", "t", "pdf", c) for i, c in edited] + [(edited[0][0], "p", "t", "pdf", edited[0][1])], extra=True)
    want = near_pairs(edited)
    for block in (2_000, 2):  # with 2, every shared anchor is split into blocks
        got = [tuple(r) for r in near_duplicates.similar_pairs(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r for r in near_duplicates.duplicate_groups(df).collect()}
    assert set(groups) == {i for i, _ in edited}
    parent = {i: i for i, _ in edited}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: r.group_id for i, r in groups.items()} == {i: root(i) for i in parent}
    assert groups["n3"].links == 0


def test_p1_large_group_of_near_copies(spark):
    """A third of all rows are edits of one text: their sequences are common, and yet they are found."""
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(500)]
    hot = [rng.choice(vocab) for _ in range(60)]
    rows = [(f"h{k}", " ".join(hot[:k] + [f"edit{k}"] + hot[k + 1 :])) for k in range(30)]
    rows += [(f"r{k}", " ".join(rng.choice(vocab) for _ in range(60))) for k in range(60)]
    got = {tuple(r) for r in near_duplicates.similar_pairs(chunks(spark, [(i, "p", "t", "pdf", c) for i, c in rows])).collect()}
    assert got == near_pairs(rows)


def test_p1_hot_group_with_insertions(spark):
    """A third of all rows are one text with inserted runs: base and copies have other shares of common sequences, and are found all the same."""
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(2_000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    hot = draw(120)
    rows = []
    for k in range(150):
        at, n = rng.randrange(20, 100), 0 if k < 10 else rng.randrange(40, 100)
        rows.append((f"h{k:03}", " ".join(hot[:at] + ([f"edit{k}"] if n == 0 else draw(n)) + hot[at:])))
    rows += [(f"r{k}", " ".join(draw(120))) for k in range(300)]
    g = {i: grams(c) for i, c in rows}
    alike = {(a, b): len(g[a] & g[b]) / len(g[a] | g[b]) for a, b in near_pairs(rows)}
    base = {p for p in alike if (p[0] < "h010") != (p[1] < "h010") and alike[p] < 0.7}
    df = chunks(spark, [(i, "p", "t", "pdf", c) for i, c in rows])
    got = {tuple(r) for r in near_duplicates.similar_pairs(df).collect()}
    assert got <= set(alike) and len(base) > 500
    assert len(got & base) >= 0.95 * len(base)
    assert len(got) >= 0.95 * len(alike)


def test_p1_anchor_code():
    """Fingerprints that differ in at most two of seven symbols share an anchor, whatever the places; so do four fifths of those that differ in three."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, (1, 4, 7)).astype(np.uint64)
    keys = near_duplicates.anchor_keys(a).reshape(4, 7)
    assert len(set(keys.reshape(-1))) == 28
    met = {n: [] for n in range(8)}
    for n in range(8):
        for places in itertools.combinations(range(7), n):
            b = a.copy()
            b[:, :, places] += np.uint64(9)
            other = near_duplicates.anchor_keys(b).reshape(4, 7)
            met[n] += [bool(set(x) & set(y)) for x, y in zip(keys, other)]
    assert all(met[0] + met[1] + met[2]) and sum(met[3]) == 28 * 4 and sum(met[4]) == 7 * 4 and not any(met[5] + met[6] + met[7])


def test_p1_code_covers():
    """The places that anchors leave open are the codewords of weight four of a linear code of distance three."""
    words = {sum(1 << i for i in range(7) if i not in kept) for kept in near_duplicates.KEPT}
    assert len(words) == 7 and all(w.bit_count() == 4 for w in words)
    code = {0} | words | {127 ^ w for w in words} | {127}
    assert len(code) == 16 and all(x ^ y in code for x in code for y in code) and all((x ^ y).bit_count() >= 3 for x in code for y in code if x != y)
    assert all(any(e & ~w == 0 for w in words) for e in range(128) if e.bit_count() <= 2)


def test_p2_cases(spark):
    q = "What net income did Acme Foods report for FY2020?"
    cases = {
        None: "empty", "": "empty", " ": "empty", "N/A": "empty", "**Answer:**": "empty", "```\n```": "empty",
        "Acme Foods reported net income of $5.0 million for": "truncated",
        "I cannot answer this from the documents I was given.": "refusal",
        "I could not find a restated number, but the filing shows $79.64 billion for net income.": None,
        q: "copy", f"**Question:** {q}": "copy", q.lower(): "copy", f"{q}\n\n{q}": "copy",
        "En FY2020, el beneficio neto de Acme Foods fue de $40 million, sobre todo por el mayor volumen.": "language",
        "Laut Bericht lag der Umsatz bei $5.0 million. Der Grund dafür war vor allem der höhere Absatz.": "language",
        "$5.0 million": None, "- Net income: $5.0 million\n- Prior year: $4.0 million": None, "The net income of Acme Foods came to $5.0 million in FY2020.": None,
        "| Item | FY2020 |\n| --- | --- |\n| Net income | $5.0 million |": None, "The unit once known as \"Gesellschaft für Acme\" is included. Net income was $5.0 million.": None,
    }
    rows = [(k, q, a, None) for k, a in enumerate(cases)] + [(100 + k, q, f"The net income of Acme Foods came to ${k}.5 million in FY2020.", None) for k in range(60)]
    df = spark.createDataFrame([*rows, rows[0], (None, q, "", None)], "result_id long, question string, model_answer string, error string").withColumn("half", F.lit(1))
    got = {r.result_id: r.defect for r in answer_defects.found(df).collect()}
    assert got == {k: v for k, v in enumerate(cases.values()) if v}
    assert answer_defects.found(df.limit(0)).count() == 0


def test_p2_label_model_separates_agreeing_functions():
    p = answer_defects.fit({"++0+": 40, "----": 900, "--0-": 900, "-+0+": 3}, "empty")
    assert p["++0+"] > 0.99 and p["--0-"] < 0.01
    assert 0.5 <= answer_defects.cutoff({"++0+": 40, "--0-": 900}, p) < 1


def test_p3_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        t = rng.choice(["abc", "ABC ", " abc", "xyz", None, " "])
        lines = [f"line {rng.randrange(10**6)} of {k}" for _ in range(3)] + ["", "---"]
        if rng.random() < 0.4:
            lines.append(f"All RIGHTS reserved, {rng.randrange(100)}.")
        if rng.random() < 0.1:
            lines.append("Share this page")
        rng.shuffle(lines)
        rows.append((f"i{k}", f"p{k // 2}", t, "pdf", "\n".join(lines)))
    rows += [("nul", "p0", "abc", "pdf", None), ("emp", "p0", "abc", "pdf", ""), rows[5]]
    papers, where = defaultdict(set), defaultdict(set)
    on = defaultdict(set)
    for i, p, t, _, c in rows:
        t = (t or "").strip().upper()
        if t:
            papers[t].add(p)
            for n, line in enumerate((c or "").split("\n"), 1):
                key = re.sub(r"\d+", "0", "".join(ch for ch in line.lower() if ch.isalnum()))
                if key:
                    on[t, key].add(p)
                    where[t, key].add((i, n))
    want = {x for k, v in on.items() if len(v) >= 5 and 5 * len(v) >= len(papers[k[0]]) for x in where[k]}
    assert want
    df = chunks(spark, rows, extra=True).repartition(5)
    for how in ({}, {"capacity": 2}, {"held": 1}):  # too small a summary yields more candidates, never other results
        got = [tuple(r) for r in site_lines.found_lines(df, **how).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    text = {i: c for i, _, _, _, c in rows}
    for r in site_lines.without_lines(df).collect():
        cut = {n for i, n in want if i == r.id}
        c = text[r.id]
        assert r.content == (c if c is None else "\n".join(x for n, x in enumerate(c.split("\n"), 1) if n not in cut)) and r.removed == len(cut)
    assert site_lines.found_lines(df.limit(0)).count() == 0


def test_p3_many_lines_a_paper(spark):
    """400 lines a paper: the weight that the summaries prune passes the threshold, and every repeated line is found all the same."""
    rng = random.Random(9)
    rows, want = [], set()
    site = [f"site line {c}" for c in "abcdefghij"]
    on = {x: set(rng.sample(range(400), 100)) for x in site}
    for k in range(400):
        lines = ["".join(rng.choices("klmnopqrstuvw", k=12)) for _ in range(390)] + [x for x in site if k in on[x]]
        rng.shuffle(lines)
        want |= {(f"i{k}", n) for n, x in enumerate(lines, 1) if x in on}
        rows.append((f"i{k}", f"p{k}", "abc", "pdf", "\n".join(lines)))
    df = chunks(spark, rows).repartition(12)
    got = [tuple(r) for r in site_lines.found_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_p4_round_trip(spark):
    rng = random.Random(2)
    limits = spark.createDataFrame([("pdf", "words", 30, 5), ("other", "words", 20, 0), ("container", "tokens", 64, 0)], "item_kind string, size_unit string, max_size int, overlap_size int")
    seps = [" ", " ", ". ", "\n", "\n\n", ", ", " ", "; "]
    text = {f"i{k}": "".join(f"{rng.choice('aB3')}{j}{rng.choice(seps)}" for j in range(rng.randrange(1, 140))) for k in range(60)}
    text |= {"none": " ".join("x" for _ in range(31)), "fits": " ".join("x" for _ in range(30)), "huge": "word " * 50_000, "empty": "", "null": None}
    kinds = {i: rng.choice([".PDF", "pdf ", "Pdf"]) if k % 2 else rng.choice([None, "", "odd"]) for k, i in enumerate(text)} | {"none": "pdf", "fits": "pdf"}
    df = chunks(spark, [(i, "p", "t", kinds[i], c) for i, c in text.items()] + [("none", "p", "t", "pdf", text["none"])], extra=True)
    got = defaultdict(list)
    for r in splitting.pieces(df, limits).orderBy("id", "piece_no").collect():
        got[r.id].append(r)
    size = lambda i: (30, 5) if (kinds[i] or "").strip().lower().lstrip(".") == "pdf" else (20, 0)
    assert set(got) == {i for i, c in text.items() if len((c or "").split()) > size(i)[0]} == {r.id for r in splitting.oversized(df, limits).collect()}
    for i, rows in got.items():
        words, done = text[i].split(), []
        for k, r in enumerate(rows, 1):
            own = r.text.split()
            assert r.piece_no == k and r.n_pieces == len(rows) and own == words[r.first_word : r.first_word + r.n_words] and len(own) <= size(i)[0]
            assert len(done) - r.first_word == (size(i)[1] if k > 1 else 0)
            done = done[: r.first_word] + own
        assert done == words


def test_p4_strongest_cut_and_ties_to_the_right():
    t = splitting.RangeMaximum(splitting.np.array([0, 3, 1, 3, 0, 2, 2]))
    for lo in range(7):
        for hi in range(lo, 7):
            v = [0, 3, 1, 3, 0, 2, 2]
            assert t.query(lo, hi) == max(range(lo, hi + 1), key=lambda k: (v[k], k))
    assert splitting.split_text("one two three. Four five six seven", 5, 1)[0][2] == "one two three."


def test_p5_matches_brute_force_and_truth_discovery(spark, sf):
    schema = "fact_id long, filing_id long, tag string, canonical_field string, value double, unit string, period_start date, period_end date, duration_days int, is_instant boolean, source_page string"
    from datetime import date as D

    rows = [
        (1, 10, "t", "Net Income", 5.0, "USD", D(2020, 1, 1), D(2020, 3, 31), 90, False, "n/a"),
        (2, 11, "t", "net_income", float("nan"), None, None, D(2020, 4, 2), 92, False, "p. 3"),
        (3, 12, "t", "netIncome", 6.0, " ", None, D(2020, 3, 30), None, None, None),  # a point in time: no group
        (4, 12, "t", "net-income", 6.0, "usd", D(2020, 1, 1), D(2020, 6, 30), 181, False, "p. 4"),
        (5, 99, "t", "net_income", 5.0, "USD", None, D(2020, 3, 31), 90, False, "p. 1"),  # unknown filing
        (6, 10, "t", "net_income", 5.0, "USD", None, None, 90, False, "p. 1"),
        (7, 11, "t", "cash", None, None, None, D(2020, 3, 31), None, True, "--"),
        (8, 12, "t", "cash", None, None, None, D(2020, 3, 31), None, True, "?"),
    ]
    facts = spark.createDataFrame([*rows, rows[0]], schema).withColumns({"field": F.lit("x"), "length": F.lit(1)})
    filings = spark.createDataFrame([(10, 1, D(2020, 5, 1)), (11, 1, None), (12, 1, D(2020, 6, 1))], "filing_id long, company_id long, filed_date date")
    got = {tuple(r) for r in survivors.latest_survivors(facts, filings).collect()}
    assert got == {(1, "value", 1), (1, "unit", 1), (1, "period_start", 1), (1, "period_end", 1), (1, "duration_days", 1), (1, "source_page", 2), (7, "period_end", 8)}
    assert survivors.latest_survivors(facts.limit(0), filings).count() == 0
    # three sources agree on every quantity, one differs everywhere: it loses trust and its values
    many = [(100 * q + s, s, "t", f"field{q}", 1.0 * q if s < 4 else 77.0, "USD", D(2020, 1, 1), D(2020, 12, 31), 365, False, "p. 1") for q in range(1, 6) for s in range(1, 5)]
    fl = spark.createDataFrame([(s, 1, D(2021, s, 1)) for s in range(1, 5)], "filing_id long, company_id long, filed_date date")
    best, trust = survivors.truth_discovery(spark.createDataFrame(many, schema), fl)
    assert {float(r.value) for r in best.where("field_name = 'value'").collect()} == {1.0, 2.0, 3.0, 4.0, 5.0}
    w = {r.filing_id: r.reliability for r in trust.collect()}
    assert w[4] < min(w[1], w[2], w[3])


def test_p6_plan_and_containers(spark):
    rng = random.Random(4)
    h = {n: rng.randrange(1, 200) for n in rng.sample(range(1, 65), 30)}
    seg, containers = packing.plan(h, 64)
    load, slots = defaultdict(int), defaultdict(list)
    for n, k in h.items():
        own = sorted((s for s in seg.tolist() if s[0] == n), key=lambda s: s[1])
        for r in range(k):
            s = [x for x in own if x[1] <= r][-1]
            c = s[2] + (r - s[1]) // s[3]
            load[c] += n
            slots[c].append((s[4] + (r - s[1]) % s[3] * n, n))
    assert set(load) == set(range(containers)) and max(load.values()) <= 64
    for own in slots.values():
        own.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:]))
    limits = spark.createDataFrame([("container", "tokens", 128, 0)], "item_kind string, size_unit string, max_size int, overlap_size int")
    texts = [(k, "revenue rose again " * rng.randrange(1, 60)) for k in range(200)] + [(900, None), (901, ""), (902, "é ﻿ ünïcode text, 12.5%\n\n x" * 3), (903, "long text " * 20_000), (0, "revenue")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("rank", F.lit(1))
    rows = packing.pack(df, limits).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == {i for i, _ in texts} and all(by[i][0].container_id is None for i in (900, 901))
    count = packing.TokenCounter(packing.TOKENIZER)
    for i, t in texts[1:-1]:
        own = sorted(by[i], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in own) == count(t) and (len(own) == 1 or count(t) > 128)
    full = defaultdict(int)
    for r in rows:
        if r.container_id is not None:
            full[r.container_id] += r.n_tokens
    assert max(full.values()) <= 128 and sum(full.values()) / (128 * len(full)) > 0.95
    assert packing.pack(df.limit(0), limits).count() == 0


def test_p6_counts_are_the_tokenizers(sf, spark):
    count = packing.TokenCounter(packing.TOKENIZER)
    for r in read_table(spark, sf, "documents").select("text").collect():
        assert count(r.text) == len(count._encode(r.text))
    for t in ("a\x1cb \x1f  c", "it's  we'll\t\n x_y--z  ", "'''s 's"):
        assert count(t) == len(count._encode(t))


def test_p7_matches_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"t{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 50)))) for k in range(30)]
    docs = []
    for k in range(200):
        ws = [rng.choice(vocab + [f"u{k}"]) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            src = rng.choice(items)[1].split()
            a, n = rng.randrange(len(src)), rng.randrange(8, 20)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = src[a : a + n]
        docs.append((k, rng.choice([" ", "\n", ", ", " - "]).join(ws).upper() if k % 2 else " ".join(ws)))
    docs += [(500, None), (501, ""), docs[0], (502, items[0][1] + " " + items[1][1]), (503, "t1 " * 40_000)]
    grams12 = defaultdict(set)
    for i, t in items:
        w = W.findall(t)
        for k in range(len(w) - 11):
            grams12[tuple(w[k : k + 12])].add(i)
    want = set()
    for i, t in docs:
        w = W.findall((t or "").lower())
        for k in range(len(w) - 11):
            want |= {(i, x) for x in grams12.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame([*items, (77, None), (78, ""), items[3]], "item_id long, item_text string")
    for block in (20_000, 7):
        got = [tuple(r) for r in leakage.leaks(d, it, block=block).collect()]
        assert want and len(got) == len(set(got)) and set(got) == want
    text, item = dict(docs), dict(items)
    for r in leakage.matches(d, it).collect():
        assert W.findall(text[r.doc_id].lower())[r.doc_word : r.doc_word + r.n_words] == W.findall(item[r.item_id])[r.item_word : r.item_word + r.n_words] and r.n_words >= 12
    assert leakage.without_leaks(d, it).count() == sum(i not in {x for x, _ in want} for i, _ in docs)
    assert leakage.leaks(d.limit(0), it).count() == 0 and leakage.leaks(d, it.limit(0)).count() == 0


def test_p7_suffix_array_orders_all_suffixes():
    import numpy as np

    a = np.random.default_rng(2).integers(0, 4, 300)
    order = leakage.suffix_array(a, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: a[i:].tolist())


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Net sales of {{company_name}} rose.", "placeholder"), ("Signed: ________", "placeholder"), ("sales in [insert region here] rose", "placeholder"), ("about [●] million", "placeholder"), ("up XX.X% on the year", "placeholder"), ("fell to $X,XXX", "placeholder"), ("see <%= page %>", "placeholder"),
        ("Amounts in [brackets] are negative; see [Page 33] and [Note 4].", None), ("Ratios of {1.2, 1.4} and <b>14%</b> were applied [unaudited].", None), ("Schedule XXI of the deed &amp; annex &NBSP; apply.", None),
        ("Sales rose by 3% in the year.\nLorem ipsum dolor sit amet.", "filler"), ("Dummy paragraph for layout purposes only.", "filler"), ("asdf asdf qwer asdf jkl", "filler"), ("The pro forma and pari passu clauses were left as they were.", None),
        ("Home | Filings | Help\n404 Not Found\nserver/1.2", "error_page"), ("SOMETHING WENT WRONG ON OUR SIDE. REFERENCE: 4EA43106", "error_page"), ("<Error><Code>NoSuchObject</Code></Error>", "error_page"),
        ('The site returned "page not found" notices during the migration in fiscal 2021.', None), ("Please enable JavaScript to view this filing.", "script_notice"),
        ("Sales rose by three percent in the year.\nFor the interactive version, enable JavaScript in your browser.", None), ("", None), (None, None), ("  \n", None),
    ],
)
def test_p8_kinds(text, kind):
    assert residue.kind_of(text, residue.TemplateTree()) == kind


def samples(items, rng):
    """A text that the parsed pattern may match."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            pick = {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: {"CATEGORY_DIGIT": "3", "CATEGORY_WORD": "w", "CATEGORY_SPACE": " "}.get(str(v), "-")}
            kind, v = rng.choice([x for x in arg if str(x[0]) != "NEGATE"])
            out += pick[str(kind)](v)
        elif name in ("ANY", "NOT_LITERAL"):
            out += " "
        elif name == "SUBPATTERN":
            out += samples(arg[3], rng)
        elif name == "BRANCH":
            out += samples(rng.choice(arg[1]), rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(samples(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif name == "ASSERT":
            out += " " + samples(arg[1], rng)
    return out


@pytest.mark.parametrize("name", ["_FILLER", "_SCRIPT", "_ERROR"])
def test_p8_marks_stand_in_all_that_the_patterns_match(name):
    pattern, marks = getattr(residue, name), getattr(residue, f"{name}_MARKS")
    rng = random.Random(1)
    missed, without = set(), []
    for b in re._parser.parse(pattern.pattern, re.I)[0][1][1]:
        own = [t for t in (samples(b, rng) for _ in range(400)) if pattern.search(t)]
        without += [] if own else [b]
        missed |= {t for t in own if not any(m in t.lower() for m in marks) and not (name == "_ERROR" and residue._STATUS.search(t))}
    assert not without and not missed


@pytest.mark.parametrize(
    ("text", "kind"),
    [("The page you requested is no longer available.", "error_page"), ("You do not have access to this filing.", "error_page"), ("This page can not be found.", "error_page"), ("Your text", "filler"), ("Net sales rose by 3%.\nYour text here", "filler"), ("PERMıSSION DENıED", "error_page")],
)
def test_p8_lines_that_had_no_mark(text, kind):
    assert residue.kind_of(text, residue.TemplateTree()) == kind


LONG = "a short description of the principal risk factors and of what was done about them"


@pytest.mark.parametrize(
    "slot",
    [f"[Insert {LONG} here]", f"(insert {LONG})", f"<Enter {LONG}>", f"[name of {LONG}]", f"[{LONG} to be confirmed]", "{{ company.profile.%s }}" % LONG.replace(" ", "_"), "{%% if %s %%}" % LONG, "<%%= %s %%>" % LONG, "${%s}" % LONG.replace(" ", "_"), "{!%s}" % LONG, f"[[ {LONG} ]]"],
)
def test_p8_long_slots(slot):
    assert residue.kind_of(f"Sales rose in {slot} over the year.", residue.TemplateTree()) == "placeholder"
    broken = slot.replace("description", "descrip\ntion")
    assert residue.kind_of(f"Sales rose in {broken} over the year.", residue.TemplateTree()) is None


def test_p8_verdicts_do_not_depend_on_earlier_lines():
    groups = [
        ["Status: 200", "Status: 503"], ["charge of the year net (312)", "charge of the year net (412)"], ['{"status": 200}', '{"status": 4041}', '{"status": 404}'], ["Error 4045", "Error 404"],
        ["1 1 1 1 1 1 1 1", "1 2 3 4 5 6 7 8"], ["qwer1 qwer1 jkl1 qwer1 qwer1 jkl1 qwer1 qwer1", "qwer1 qwer2 jkl3 qwer4 qwer5 jkl6 qwer7 qwer8"],
        ["the new viewer of the firm gave alpha to all", "the new viewer of the firm gave beta to all", "the new viewer of the firm gave forbidden to all"],
    ]
    for g in groups:
        want = [residue.classify(t) for t in g]
        assert len(set(want)) > 1
        for lines in (g, g[::-1]):
            tree = residue.TemplateTree()
            assert {t: tree.verdict(t) for t in lines} == dict(zip(g, want))


def test_p8_table(spark):
    d = spark.createDataFrame([(1, "404 Not Found"), (1, "404 Not Found"), (2, None), (3, "sales of the unit rose " * 20_000), (None, "404 Not Found"), (4, "fee of {{x}}")], "doc_id long, text string").withColumn("kind", F.lit("z"))
    assert sorted(tuple(r) for r in residue.kinds(d).collect()) == [(1, "error_page"), (4, "placeholder")]
    assert residue.kinds(d.limit(0)).count() == 0
    assert {r.doc_id for r in residue.without_residue(d).collect()} == {2, 3, None}


def test_queries_run_on_the_test_tables(spark, sf):
    columns = {"p1_found": ["id_a", "id_b"], "p2_found": ["result_id", "defect"], "p3_found": ["id", "line_no"], "p4_found": ["id"], "p5_found": ["group_id", "field_name", "fact_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind"]}
    for name, f in queries.queries().items():
        df = f(spark, sf)
        assert df.columns == columns.get(name, df.columns), name
        assert df.count() > 0, name


def test_queries_match_their_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("chunks", "filings", "financial_facts", "documents", "eval_items", "size_limits"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        got = c.execute(sql)
        assert [d[0] for d in got.description] == df.columns, name
        assert sorted(tuple(r) for r in df.collect()) == sorted(got.fetchall()), name


def mined_corpus():
    """Texts, a message and stand-in copy that no rule knows, and one short text under several ids."""
    rng = random.Random(8)
    vocab = [f"v{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    sentence = lambda: "the " + " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 14))) + "."
    rows, want = [], set()
    for i in range(120):
        rows.append((i, " ".join(sentence() for _ in range(rng.randint(3, 9)))))
    for i in range(200, 212):
        message = f"our gate let nobody through to {rng.choice(vocab)}{i} this morning."
        rows.append((i, rng.choice([message, message.upper(), f"Home | Help\n\n{message}", f"{message} Menu\nContact"])))
        want.add((i, "error_page"))
    for i in range(300, 308):
        copy = f"real prose about {rng.choice(vocab)} comes to this spot."
        rows.append((i, f"{sentence()} {sentence()}\n\n" + " ".join([copy] * rng.choice([1, 3]))))
        want.add((i, "filler"))
    rows += [(400 + k, "the same short report stands under several ids.") for k in range(5)]
    return rows, want


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_p8_mined_templates(spark, parts):
    rows, want = mined_corpus()
    random.Random(parts).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {tuple(r) for r in residue.kinds(d).collect()}
    assert got == want
    mined = residue.mined_templates(residue.read_records(d)).collect()
    assert sorted(r.kind for r in mined) == ["filler", "notice"]


def test_p8_repeats():
    assert residue.period_of("a b c a b c a".split()) == 3 and residue.period_of("a b c d a".split()) == 5
    assert residue.period_of("f b z q f b z f b z q f b z".split()) == 4
    assert residue.repeated_tail("x y a b c a b c".split()) == 6 and residue.repeated_tail("a b c d e f g c".split()) == 0
    assert residue.repeated_tail(["a"] * 100_000) == 0 and residue.period_of(["a", "b"] * 100_000) == 2


def test_p2_validated_cutoffs_and_defects():
    """Each defect put into sound pairs is told by its votes; cutoffs lie between both."""
    rng = random.Random(2)
    model = answer_defects.LetterModel([])
    pairs = [(f"What net income did Acme{k} Foods report for FY2020?", f"The net income of Acme{k} Foods came to ${rng.randint(1, 99)}.5 million in FY2020, which was due to higher volume.") for k in range(100)]
    pairs += [(f"Wie hoch war der Umsatz von Acme{k} im Jahr 2020?", f"Laut Bericht lag der Umsatz von Acme{k} bei ${k}.5 million, und das war vor allem dem höheren Absatz zu verdanken.") for k in range(100)]
    code = {1: "+", 0: "0", -1: "-"}
    for d in answer_defects.DEFECTS:
        k = len(answer_defects.PRIORS[d][0])
        counts = {}
        for q, a in pairs:
            p = "".join(code[v] for v in answer_defects.votes(q, a, None, model)[d])
            counts[p] = counts.get(p, 0) + 1
        post = answer_defects.fit(counts, d)
        assert len(post) == 3**k and all(post[p] < 0.3 for p in counts), d
    posterior = {d: answer_defects.fit({}, d) for d in answer_defects.DEFECTS}
    cuts = answer_defects.validated(pairs, posterior, model)
    others = {"en": [a for _, a in pairs[:100]], "de": [a for _, a in pairs[100:]]}
    assert all(0.3 <= c < 1 for c in cuts.values())
    for d in answer_defects.DEFECTS:
        for k, (q, a) in enumerate(pairs):
            bad = answer_defects.with_defect(d, k, q, a, others)
            v = "".join(code[x] for x in answer_defects.votes(q, bad, None, model)[d])
            assert posterior[d][v] >= cuts[d], (d, bad)


def test_p2_letters_are_learned_from_all_rows(spark, monkeypatch):
    """Dutch stands only in the rows whose ids have the largest hashes, behind 21 000 others."""
    ids = [r.id for r in spark.range(21_040).orderBy(F.xxhash64("id")).collect()]
    english = ("What was the revenue of the unit?", "It was up on the year before, and that is what they would have had.")
    dutch = ("Wat is het aandeel van de eenheid?", "Volgens het jaarverslag werd de omzet van het bedrijf door de verkoop ten opzichte van het vorig jaar niet lager.")
    rows = [(i, *(english if k < 21_000 else dutch), None) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "result_id long, question string, model_answer string, error string").repartition(8)
    models = []
    monkeypatch.setattr(answer_defects, "partial", lambda f, *a, **how: models.append(how["model"]) or partial(f, *a, **how))
    answer_defects.labelled(df).count()
    assert models[0].languages == ["en", "nl"]


def test_p2_cutoffs_stand_on_all_pairs(spark):
    """Counts of votes and of tests take in every pair once, whatever the partitions and repeats."""
    rng = random.Random(9)
    rows = [(k, f"What net income did Acme{k} Foods report for FY2020?", f"The net income of Acme{k} Foods came to ${rng.randint(1, 99)}.5 million in FY2020, which was due to higher volume.", None) for k in range(3_000)]
    rows += [(3_000 + k, f"Wie hoch war der Umsatz von Acme{k} im Jahr 2020?", f"Laut Bericht lag der Umsatz von Acme{k} bei ${k}.5 million, und das war vor allem dem höheren Absatz zu verdanken.", None) for k in range(1_000)]
    rows += [(4_000 + k, "What net income did Acme report?", None, None) for k in range(50)]
    model = answer_defects.LetterModel([])
    posteriors = [{d: answer_defects.fit({}, d) for d in answer_defects.DEFECTS}] * answer_defects.FOLDS
    schema = "result_id long, question string, model_answer string, error string"
    got = []
    for n in (1, 7):
        voted = answer_defects.voted_on(spark.createDataFrame(rows, schema).repartition(n), model)
        votes, tests = answer_defects.pattern_counts(voted).collect(), answer_defects.counts_of_tests(voted, posteriors, model).collect()
        for d in answer_defects.DEFECTS:
            assert sum(r.n for r in votes if r.defect == d) == 4_050 and {r.fold for r in votes} == set(range(answer_defects.FOLDS))
            assert sum(r.n for r in tests if r.defect == d and not r.made) == 4_000
        assert 3_990 <= sum(r.n for r in tests if r.made) <= 4_000  # hardly any pair can't have its defect
        got.append((set(votes), set(tests)))
    assert got[0] == got[1]
    once, twice = (answer_defects.labelled(spark.createDataFrame(r, schema)) for r in (rows, rows + rows[::-1]))
    assert set(once.collect()) == set(twice.collect()) and once.count() == twice.count() == 50


def test_p2_words_of_the_question_say_nothing_of_the_language():
    model = answer_defects.LetterModel([])
    v = answer_defects.votes("What diluted earnings per share did Acme report?", "| Item | Prior |\n| --- | --- |\n| Diluted earnings per share | $1.27 |", None, model)
    assert v["language"] == (0, 0, 0)
    v = answer_defects.votes("How large was the income tax charge of ZKC in FY2018?", "A empresa registou $5.6 million no período FY2018, conforme a nota 4.", None, model)
    assert v["language"][0] == v["language"][2] == 1 or v["language"][2] == 1


def test_p5_chains_of_admissible_pairs(spark):
    """Combinations of (end, length) against a union of all admissible pairs."""
    rng = random.Random(5)
    sets = [[(1, 116), (5, 111), (6, 95), (13, 104)]] + [[(rng.randint(0, 40), rng.randint(80, 150)) for _ in range(9)] for _ in range(150)]
    rows = [(k * 100 + i, k, "f", False, d, n) for k, s in enumerate(sets) for i, (d, n) in enumerate(dict.fromkeys(s))]
    df = spark.createDataFrame(rows, "id long, company_id long, field string, is_point boolean, end_day int, length int")
    got = {r.id: r.root for r in survivors.linked(df).collect()}
    for k, s in enumerate(sets):
        own = list(dict.fromkeys(s))
        root = list(range(len(own)))
        for _ in own:
            for i, (d, n) in enumerate(own):
                for j, (e, m) in enumerate(own):
                    if abs(d - e) <= 7 and abs(n - m) <= 12:
                        root[i] = root[j] = min(root[i], root[j])
        assert [got[k * 100 + i] for i in range(len(own))] == [k * 100 + r for r in root], own
    assert len({got[i] for i in range(4)}) == 2


def test_p8_wildcards_are_no_repeated_word():
    tree = residue.TemplateTree()
    line = "until harbour vessels unload grain beside quays some evenings until"
    assert tree.verdict(line) == residue.classify(line) == "text"
