"""Operators for training data against brute force and on the cases they must tell apart."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import frequent, leakage, packing, residue
from tidemark.llm.cells import text_cells
from tidemark.llm.distinct import bitmap_bits, bitmap_partials, bitmaps, distinct_counts, estimates, merge_partials, relative_error
from tidemark.llm.normal import words_line
from tidemark.llm.queries import CAPACITY, QUERIES

# ---- distinct counts


def test_bits_meet_the_error():
    for capacity in (1, 100, 10**5, 10**7):
        for error in (0.1, 0.01):
            bits = bitmap_bits(capacity, error)
            assert bits % 64 == 0 and relative_error(capacity, bits) <= error
            assert bits == 64 or bitmap_bits(capacity, error * 0.9) >= bits
    with pytest.raises(ValueError):
        bitmap_bits(10, 0)


def test_distinct_counts(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice(["a", "b", None]), None if rnd.random() < 0.05 else rnd.randint(0, 3000), i) for i in range(20000)]
    df = spark.createDataFrame(rows, "day int, app string, ip int, word int")
    got = distinct_counts(df, ["day", "app"], "ip", 3001, 0.02).collect()
    want = {}
    for level in (("day", "app"), ("day",), ("app",), ()):
        for d, a, ip, _ in rows:
            key = (",".join(level), d if "day" in level else None, a if "app" in level else None)
            want.setdefault(key, set()).add(ip)
    assert {(r.level, r.day, r.app) for r in got} == set(want)
    for r in got:
        n = len(want[r.level, r.day, r.app] - {None})
        assert not r.saturated and abs(r.estimate - n) <= 5 * 0.02 * n + 3
        assert r.std_error <= 0.02


def test_partials_merge_and_edges(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    bits = bitmap_bits(1000, 0.02)
    whole = bitmap_partials(df, ["g"], "x", bits)
    parts = merge_partials(*[bitmap_partials(df.filter(f"x % 2 = {i}"), ["g"], "x", bits) for i in (0, 1)])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    none = spark.createDataFrame([(1, None)], "g int, x int")
    assert [tuple(r) for r in estimates(bitmap_partials(none, ["g"], "x", 64), ["g"], 64).collect()] == [(1, 0.0, 0.0, False)]
    full = estimates(bitmap_partials(df, ["g"], "x", 64), ["g"], 64).first()
    assert full.saturated and full.estimate is None
    assert distinct_counts(none.filter("false"), ["g"], "x", 5).collect() == []


def test_partials_say_their_size(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    one, two = (bitmaps(df.filter(f"x % 2 = {i}"), ["g"], "x", 1000, 0.02) for i in (0, 1))
    whole = bitmaps(df, ["g"], "x", 1000, 0.02)
    assert sorted(map(tuple, merge_partials(one, two).collect())) == sorted(map(tuple, whole.collect()))
    assert {r["size"] for r in whole.collect()} == {bitmap_bits(1000, 0.02)}
    with pytest.raises(Exception, match="different sizes"):
        merge_partials(one, bitmaps(df, ["g"], "x", 100_000, 0.02)).collect()


# ---- frequent items


def test_frequent_items(spark):
    rnd = random.Random(5)
    rows = [(None if rnd.random() < 0.1 else int(rnd.paretovariate(0.9)) % 5000, rnd.choice(["x", "y", f"r{i}"])) for i in range(30000)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = {(r.field_name, r.field_value): r for r in frequent.frequent_items(df, ["a", "b"], 0.01).collect()}
    want = {("a", str(k)): n for k, n in Counter(r[0] for r in rows if r[0] is not None).items() if n >= 300} | {("b", k): n for k, n in Counter(r[1] for r in rows).items() if n >= 300}
    assert {k: r["count"] for k, r in got.items()} == want
    assert all(abs(r.approx_count - r["count"]) < 300 for r in got.values())
    assert frequent.frequent_items(df.filter("false"), ["a", "b"], 0.01).collect() == []
    assert frequent.frequent_items(df.select(F.lit(None).cast("int").alias("a")), ["a"], 0.5).collect() == []


def test_sketch_of_parts_is_the_sketch_of_all(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("int").alias("a"))
    (n, one), (m, many) = (frequent.sketch(df.repartition(k), ["a"]) for k in (1, 6))
    assert n == m == 5000 and np.array_equal(one, many)


# ---- packing


def test_differencing_on_a_known_case():
    assert sorted(t for t, _ in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.differencing([], 3) == [] and packing.differencing([5], 3) == [(5, [0])]


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(0, 100), rnd.randint(0, 30), 50, 100]) for _ in range(rnd.choice([1, 7, 300]))]
    windows = packing.pack(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows)
    least = packing.windows_needed(sizes, 100)
    assert least <= len(windows) <= math.ceil(1.15 * least) + 1


@pytest.mark.parametrize("seed", range(4))
def test_fill_of_documents_of_all_lengths(seed):
    """Sizes spread as those of documents are: close to the lower bound of windows."""
    rnd = random.Random(seed)
    sizes = [int(rnd.lognormvariate(6.6, 0.9)) % CAPACITY for _ in range(1024)]
    windows = packing.pack(sizes, CAPACITY)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= CAPACITY for w in windows)
    assert len(windows) <= 1.02 * packing.windows_needed(sizes, CAPACITY) + 1


def test_two_windows_are_differenced_completely():
    rnd = random.Random(8)
    for _ in range(300):
        sizes = [rnd.randint(0, 60) for _ in range(rnd.randint(1, 7))]
        least = rnd.randint(0, sum(sizes))
        most = least + rnd.randint(0, 5)
        want = any(least <= sum(s for i, s in enumerate(sizes) if n >> i & 1) <= most for n in range(1 << len(sizes)))
        got = packing.parted(sizes, least, most)
        assert (got is not None) == want
        assert got is None or least <= sum(s for s, x in zip(sizes, got) if x) <= most


def test_a_lost_piece_is_an_error(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6])], names=["id", "tokens"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda s: 0})())
    assert sum(r["tokens"] for b in packing._packer(10, 9)([batch]) for r in b.to_pylist()) == 11
    for wrong in ([[0]], [[0, 1]]):
        monkeypatch.setattr(packing, "pack", lambda sizes, capacity, wrong=wrong: wrong)
        with pytest.raises(RuntimeError):
            list(packing._packer(10, 9)([batch]))


def test_fill_containers(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n", "é!", "a" * 33, "x" * 8 * CAPACITY, "y " * (CAPACITY + 1), "z " * (3 * CAPACITY)] + ["w " * rnd.randint(1, CAPACITY) for _ in range(300)]
    df = spark.createDataFrame([(i if i else None, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int").repartition(3)
    out = packing.fill_containers(df, "doc_id", packing.token_count(F.col("text")), CAPACITY, block=64).collect()
    size = lambda t: len(re.findall(packing.TOKEN, t or ""))
    by_doc, by_container = {}, Counter()
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_container[r.container_id] += r.tokens
    assert max(by_container.values()) <= CAPACITY
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i if i else None], key=lambda r: r.piece)
        assert sum(p.tokens for p in pieces) == size(t) and [p.first_token for p in pieces] == [CAPACITY * k for k in range(len(pieces))]
        assert len(pieces) == max(1, -(-size(t) // CAPACITY))
    assert sum(by_container.values()) / CAPACITY / sum(v > 0 for v in by_container.values()) > 0.9
    assert packing.fill_containers(df.filter("false"), "doc_id", packing.token_count(F.col("text")), CAPACITY).collect() == []


# ---- leakage

WORDS = "copper tailor basket winter seven stone quarrel ledger under bridge rather marble candle orchard lantern velvet quarter remain weaver margin pebble satchel harvest courier".split()


def passage(rnd, n=40):
    return [rnd.choice(WORDS) + str(rnd.randint(0, 9)) * rnd.randint(0, 1) for _ in range(n)]


def brute(p, t):
    """Edit-distance search for a stretch that begins and ends with words that recur."""
    for a in range(len(p)):
        row = {j: 0 for j in range(len(t)) if t[j] == p[a]}  # edits before word a at place j
        best = {j + 1 + k: k for k in reversed(range(len(p) // 5 + 1)) for j in row if j + 1 + k <= len(t)}  # k words added behind the first
        for n in range(2, len(p) - a + 1):
            w, step = p[a + n - 1], {}
            for j in sorted(best):
                for k, e in ((j, best[j] + 1), (j + 1, best[j] + (0 if j < len(t) and t[j] == w else 1))):
                    if k <= len(t):
                        step[k] = min(step.get(k, 99), e)
            for j in sorted(step):
                if j + 1 <= len(t):
                    step[j + 1] = min(step.get(j + 1, 99), step[j] + 1)
            ended = [best[j] for j in best if j < len(t) and t[j] == w]
            if n >= 16 and ended and min(ended) * 5 <= n:
                return True
            best = {j: e for j, e in step.items() if e <= len(p) / 5 + 1}
    return False


def test_alignment_against_brute_force():
    rnd, found = random.Random(11), Counter()
    for _ in range(120):
        p = passage(rnd)
        a, n = rnd.randint(0, 8), rnd.randint(12, 32)
        copy = list(p[a : a + n])
        for _ in range(rnd.randint(0, 8)):
            i = rnd.randrange(len(copy))
            kind = rnd.random()
            if kind < 0.6:
                copy[i] = "other"
            elif kind < 0.8:
                copy.insert(i, "added")
            elif len(copy) > 1:
                del copy[i]
        text = ["noise"] * 9 + copy + ["noise"] * 9
        ids = {w: k for k, w in enumerate(p)}
        pb, tb = np.array([ids[w] for w in p]), np.array([ids.get(w, -1) for w in text])
        want = brute(p, text)
        found[want] += 1
        diagonals = np.unique([j - i for i in range(len(p)) for j in range(len(text)) if p[i] == text[j]])
        assert leakage.stretch_on(pb, tb, diagonals) == want, (p, text)
        if want:
            index = leakage.Passages.of([(1, " ".join(p))])
            assert leakage.leaked_items(" ".join(text), index) == [1]
    assert min(found.values()) > 20


def test_forms_of_a_passage(spark):
    rnd = random.Random(3)
    p = "Whoever rents that spare funnel pays 13.73 shells to Nellstead's archivist; the vault holds 31 bobbins, 23 gaskets plus no trumpet since 1506."
    forms = [
        p, p.upper(), "# " + p.replace(" ", "\n# ", 6), json.dumps({"source": [p, "x"]}), json.dumps(p.replace(" ", "\n")), p.replace("'", "&#x27;").replace(" ", "&nbsp;"), re.sub(r"(\w+) (\w+)", r"**\1** <b>\2</b>", p),
        p.replace(" ", "​ "), p.replace("e", "e­"), "\x1b[31m" + p.replace(" ", "\x1b[0m "), repr(p.replace(" ", "\n    ")), p.replace(" ", "\\u00a0"), "noise " * 50 + p, p.replace("'", "’"), p.replace(" ", "_"),
    ]
    other = [None, "", " ".join(p.split()[:10]), " ".join(sorted(p.split())), " ".join(passage(rnd, 400)), " ".join(w if i % 3 else "changed" for i, w in enumerate(p.split()))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(forms + other)], "doc_id bigint, text string, item_id int").repartition(2)
    items = spark.createDataFrame([(1, p, "x"), (2, p.lower(), "x"), (3, None, "x"), (4, "too short", "x"), (None, p, "x")], "item_id bigint, passage string, text string")
    for block in (1, 1_000_000):
        got = {tuple(r) for r in leakage.leaks(docs, items, block_characters=block).collect()}
        assert got == {(d, i) for d in range(len(forms)) for i in (1, 2)}
    assert leakage.leaks(docs.filter("false"), items).collect() == [] == leakage.leaks(docs, items.filter("false")).collect()


def test_a_text_full_of_a_shared_phrase():
    shared = "read the extract and answer with a single number"
    rnd = random.Random(9)
    rows = [(i, shared + " " + " ".join(passage(rnd))) for i in range(200)]
    index = leakage.Passages.of(rows)
    text = (shared + " and go on ") * 2000
    assert leakage.leaked_items(text, index) == []
    assert leakage.leaked_items(text + rows[7][1], index) == [7]


def test_a_long_text_is_searched_in_pieces(monkeypatch):
    rnd = random.Random(4)
    p = " ".join(passage(rnd))
    index = leakage.Passages.of([(1, p), (2, " ".join(passage(rnd)))])
    for piece in (7, 64, 100):
        monkeypatch.setattr(leakage, "PIECE", piece)
        assert leakage.leaked_items("noise and " * 40 + p + " noise" * 40, index) == [1]
    assert leakage.leaked_items("", index) == leakage.leaked_items(" ", index) == []


@pytest.mark.parametrize("unit", ["\\", "\n", "<", "<!--", "&a", "\u201c", "`", '"', "$", "{{", "_", " ", "a ", "[", "«", "x\u200b", '{"cell_type": "markdown", "source": ["a'])
def test_long_runs_take_time_in_proportion(unit):
    text = unit * 100_000
    index = leakage.Passages.of([(1, " ".join(WORDS))])
    assert leakage.leaked_items(text, index) == []
    residue.residue(text, None, None)


def test_words_line():
    assert words_line("It's 3.5\\nBIG &amp; <br/>über").tobytes().decode() == " it s 3 5 big über "
    assert words_line(None).tobytes() == b" "


# ---- residue

TRUE = [
    "# {{ title }}", "# <<title>>", "Dear {% name %}, welcome", "Contact: ${author}", "<%= author %>", "## About @@title@@", "Prepared by __EMAIL__ for __UNIT__", "[DATE] - [VERSION] - [OWNER]", "Name: ________", "<your name>, <your student number>", "This notebook analyses {course} and reports {dataset}.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "blah blah blah blah blah blah", "占位文字占位文字占位文字占位文字占位文字", "## Conclusion\n\nTBD", "[Insert project title here]", "此处填写标题", "## Heading 1\n\nParagraph 1\n\n## Heading 2\n\nParagraph 2",
    "404\nNotebook not found", "502 BAD GATEWAY\n\nPROXY/6.12", "Erreur 404 : cette page n'existe pas ou plus.", "服务器内部错误（6217），请稍后再试。", "Only members of Haskstead may read this: Bitte später erneut versuchen.", "Some results follow.\n\nYour address was blocked after 802 requests\nLog in to continue.",
    "You need to enable JavaScript to run this app.", "<noscript>Please activate JavaScript to see the notebook.</noscript>", "请启用 JavaScript 以查看此笔记本。", "JAVASCRIPT IS DISABLED IN YOUR BROWSER.",
]
FALSE = [
    "", "Whatever stands in `{% email %}` is replaced when the report is rendered.", 'Older exports wrote "[Insert project title here]" into empty fields; 4.92 percent had it.', "$$ \\frac{{level_{7}}}{{1 + cellar^{{9}}}} $$", "The server answers 404 when a hall is not found and 502 when the density is down.",
    "The site builds its table with scripts, so the plain download is useless.", "The error falls from 32.63 to 10.7 once the odd rows are gone.", "We reload the page and try the query again in the next cell.", "The function f(x) = {x} maps rows to **bold __strong__ words**.", "| a | a | a | a | a |", "En Varnby el error ronda el 9 por ciento.",
]


@pytest.mark.parametrize("cell", TRUE)
def test_residue(cell):
    assert residue.residue_in(cell)[0]


@pytest.mark.parametrize("cell", FALSE)
def test_no_residue(cell):
    assert residue.residue_in(cell) == ("", 0)


def test_cells_of_every_form():
    forms = {
        "json": '{\n "nbformat": 4,\n "cells": [\n  {"cell_type": "markdown", "metadata": {}, "source": [\n    "# A\\n",\n    "say \\"hi\\""]},\n  {"cell_type": "code", "source": [\n    "TBD"],\n   "outputs": []}]}',
        "percent": "# %% [markdown]\n# # A\n# say \"hi\"\n\n# %% In[1]\nTBD\n\n# Out[1]:\n# TBD\n",
        "inout": "# A\nsay \"hi\"\n\nIn [1]:\nTBD\n\nOut[1]:\nTBD\n",
        "markdown": "# A\nsay \"hi\"\n\n```python\nTBD\n```\n\n    TBD\n",
        "html": '<div class="nb-text" data-n=" "><pre># A\nsay &quot;hi&quot;</pre></div>\n<div class="nb-code" data-n="1"><pre>TBD</pre></div>',
    }
    for name, text in forms.items():
        for t in (text, text.replace("\n", "\r\n") if name != "json" else text):
            found = " ".join(text_cells(t, None, None))
            assert "say \"hi\"" in found and "TBD" not in found, name
    assert list(text_cells("abTBD", ["text", "code"], [0, 2])) == ["ab"]


def test_scan(spark):
    rows = [(1, None, None, None, 5), (2, "", None, None, 5), (3, "fine text", ["text"], [0], 5), (4, "TBD", None, None, 5), (4, "TBD", ["code"], [0], 5), (5, "ok\nTBD", ["text", "text"], [0, 3], 5), (None, "TBD", ["text"], [None], 5), (6, "TBD", [], [], 5), (7, "x TBD", ["text", "text"], [0], 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cell_types array<string>, cell_starts array<int>, kind int")
    got = [(r.doc_id, r.cells, r.residue_cells, r.kind) for r in residue.scan_residue(df).collect()]
    assert got[:4] == [(1, 0, 0, None), (2, 0, 0, None), (3, 1, 0, None), (4, 1, 1, "prompt")] and got[4] == (4, 0, 0, None) and got[5] == (5, 2, 1, "prompt")
    assert len(got) == len(rows) and residue.scan_residue(df.filter("false")).collect() == []


def test_coverage_of_a_document():
    page = residue.residue("404 - Page not found", ["text"], [0])
    part = residue.residue("x" * 50 + " is long. " * 9 + "\n\nTBD", ["text"], [0])
    assert page[:3] == (1, 1, "error") and page[3] == 1.0
    assert part[2] == "prompt" and 0 < part[3] < 0.05
    assert residue.residue("İİ {{ name }}", ["text"], [0])[2] == "placeholder"


def test_cells_with_long_heads():
    long = '{\n "nbformat": 4, "metadata": {"title": "' + "x" * 500 + '"},\n "cells": [\n  {"cell_type": "markdown", "metadata": {}, "source": [\n    "TBD"]}\n ]\n}\n'
    assert list(text_cells(long, ["text"], [0])) == ["TBD"]
    assert "TBD" in next(iter(text_cells("<!-- " + "c" * 500 + " -->\n<!DOCTYPE html><html><body><p>TBD</p></body></html>", ["text"], [0]))).split()


def test_queries_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "click_id bigint, ip int, app int, device int, os int, channel int, click_time timestamp_ntz, is_attributed int, ingest_time timestamp_ntz").write.parquet(f"{tmp_path}/train_schema.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, cell_types array<string>, cell_starts array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).collect() == [], name
