"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from doctree.llm import chat, decontaminate, language_id, line_dedup, packing, quality_model, quality_rules, sharding, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, size int, k_text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    vocabulary = {"en": ["the", "and", "with", "thing", "worth", "when", "other"], "fr": ["où", "élève", "même", "les", "près", "être"], "de": ["über", "mäßig", "und", "größe", "nicht", "schön"]}
    rows = []
    passage = " ".join(f"shared{i}" for i in range(60))
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        body = "\n".join(" ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "s", "er", "en"]) for _ in range(12)) for _ in range(8))
        if i % 10 == 0:
            body += "\n" + passage
        if i % 4 == 0:
            body += f"\nAll rights reserved {2000 + i}."
        rows.append((i, body, lang, f"src{i % 2}"))
    copy = rows[7][1]
    words = copy.split(" ")
    near = " ".join(words[:5] + ["changed"] + words[6:])
    rows += [(100, copy, "fr", "src0"), (101, copy, None, None), (102, near, "fr", "src0"), (103, None, "en", "src0"), (104, "", "en", "src0"), (105, " \n\t ", "en", "src0"), (106, "Γ☃ 1", None, "src1")]
    rows += [(None, "no id here at all", "en", "src0"), (107, "x y", "en", "src1"), (107, "x y", "en", "src1"), (108, "long " * 30000 + passage, "en", "src0"), (109, "123 456", "en", "src0"), (110, "AA!! BB!! " * 40, "en", "src0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, len(r[1] or ""), "clash", 5, "clash") for r in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


# chat


def chat_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a ### b </turn>\n\\### c"), (1, 2, None, None), (1, 3, "assistant", None), (2, 5, "odd: role", "x"), (None, 1, "user", "no conversation"), (1, 1, "assistant", "a ### b </turn>\n\\### c")]
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chat_reads_back_what_it_formats(spark):
    rows, frame = chat_rows(spark)
    read = chat.read_back(chat.format_conversations(chat.linear(frame))).collect()
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    got = {(None if r.tree.none else r.tree.id): [(t.role, t.text) for t in r.read] for r in read}
    assert got == dict(want)
    for r in read:
        conv = None if r.tree.none else r.tree.id
        assert r.loss_text == "".join(t for role, t in want[conv] if role == "assistant")
        for span in r.turns:
            assert r.formatted[span.start :].startswith("### ") and r.formatted[: span.start + span.length].endswith("</turn>\n")


def test_chat_ranks_branches_and_skips_circles(spark):
    rows = [("t", 1, None, 0.0, "user", "root"), ("t", 2, 1, 1.0, "assistant", "low"), ("t", 3, 1, 2.0, "assistant", "high"), ("t", 4, 3, 0.5, "user", "more"), ("c", 1, 2, 1.0, "user", "x"), ("c", 2, 1, 1.0, "user", "y"), ("o", 7, 99, None, "user", "orphan")]
    frame = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double, role string, text string")
    one = {r.tree: r.formatted for r in chat.format_conversations(frame).collect()}
    assert set(one) == {"t", "o"} and re.findall(r": (\w+)</turn>", one["t"]) == ["root", "high", "more"]
    two = sorted((r["rank"], re.findall(r": (\w+)</turn>", r.formatted)) for r in chat.format_conversations(frame, 2).where("tree = 't'").collect())
    assert two == [(1, ["root", "high", "more"]), (2, ["root", "low"])]


def test_chat_long_thread(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(150)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat.read_back(chat.format_conversations(chat.linear(frame))).collect()
    assert [t.text for t in row.read] == [r[3] for r in rows]


def test_chat_empty(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_conversations(chat.linear(frame))).count() == 0


def test_chat_ties_repeated_messages_and_odd_columns(spark):
    long = "x### " * 200_000
    rows = [("t", 1, None, 0.0, "user", "root"), ("t", 3, 1, 1.0, "assistant", long), ("t", 2, 1, 1.0, "assistant", "same score"), ("t", 2, 1, 1.0, "assistant", "same score"), ("u", 1, None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "tree string, node bigint, parent bigint, score double, role string, text string, up string, formatted string")
    got = {(r.tree, r["rank"]): [t.text for t in r.read] for r in chat.read_back(chat.format_conversations(frame, 2)).collect()}
    assert got == {("t", 1): ["root", "same score"], ("t", 2): ["root", long], ("u", 1): [""]}
    chain = spark.createDataFrame([("t", i, i - 1 if i else None, 0.0, "user", str(i)) for i in range(33)], "tree string, node bigint, parent bigint, score double, role string, text string")
    assert len(chat.format_conversations(chain).first().turns) == 33


# quality rules


def repeat_words(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    return len({p + k for found in at.values() if len(found) > 1 for p in found for k in range(3)})


def test_quality_measures(docs):
    got = quality_rules.judged(docs.select("doc_id", "text", "lang", "source")).collect()
    assert len(got) == len(texts())
    want = Counter()
    for i, t, *_ in texts():
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        n = repeat_words(t)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_fences_follow_the_source(spark):
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "clean") for i in range(150)]
    noisy = [(1000 + i, " ".join(f"w{i}x{j} ##" for j in range(60)), "en", "code") for i in range(150)]
    odd = [(2000, " ".join(f"q{j} ##" for j in range(60)), "en", "clean"), (2001, " ".join(f"q{j} ##" for j in range(60)), "xx", "new")]
    frame = spark.createDataFrame(plain + noisy + odd, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.judged(frame).where("kept").collect()}
    assert 2000 not in kept and set(range(150)) <= kept and set(range(1000, 1150)) <= kept


def test_quality_thresholds_are_those_of_the_sketch(spark):
    rng = random.Random(8)
    values = [rng.choice([0, 3, 127, 128, 129, 1000, 123456789]) + rng.randint(0, 3) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for v, b in frame.select("v", quality_rules.bucket(F.col("v"))).collect():
        assert b <= v and (v - b) * 64 <= v and b == (v >> max(v.bit_length() - 7, 0)) << max(v.bit_length() - 7, 0)


def test_quality_keeps_columns_of_any_name(spark):
    names = ["words", "windows", "lines", "starts", "b0", "level", "texts"]
    frame = spark.createDataFrame([(1, "a b c " * 30, "en", "s", *names), (2, None, None, None, *names)], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    got = quality_rules.judged(frame).collect()
    assert len(got) == 2 and all([r[n] for n in names] == names for r in got) and {r.lang for r in got} == {"en", None}


def test_quality_empty(empty):
    assert quality_rules.judged(empty.select("doc_id", "text", "lang", "source")).count() == 0


# substring dedup


def test_substrings(docs):
    seen = Counter()
    for _, t, *_ in texts():
        w = words(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for i, t, *_ in texts():
        w = words(t)
        gone = {p + k for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for k in range(35)}
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.deduplicate(docs).collect()) == want


@pytest.mark.parametrize("window,run", [(5, 2), (6, 6), (4, 1)])
def test_substrings_random(spark, window, run):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = Counter(tuple(t.split()[i : i + window]) for _, t in rows for i in range(len(t.split()) - window + 1))
    want = {i: len({p + k for p in range(len(t.split()) - window + 1) if seen[tuple(t.split()[p : p + window])] > 1 for k in range(window)}) for i, t in rows}
    assert {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(frame, window=window, run=run).collect()} == want


def test_substrings_empty(empty):
    assert substring_dedup.deduplicate(empty).count() == 0


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    from doctree.llm import common

    rows = spark.createDataFrame([(k % 2 * (k % 7), k) for k in range(1000)], "key bigint, place bigint")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    found = counts.where("key in (0, 3, 5)")
    monkeypatch.setattr(common, "LEAST_HOT", 50)
    got = common.among(rows, found, ["key"], 1000, most_hot=100)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k % 2 * (k % 7), k) for k in range(1000) if k % 2 * (k % 7) in (0, 3, 5))


# packing


def test_packing_is_whole_and_tight(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs).collect()
    want = Counter()
    for i, t, *_ in texts():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_merges_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 50)
    rng = random.Random(5)
    rows = [(i, rng.choice([10, 300, 700, 900, 1100, 1500, 2048])) for i in range(600)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id bigint, length bigint")).collect()
    assert sorted((r.doc_id, r.length) for r in found) == sorted(rows)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= len(packing.best_fit(sorted((n for _, n in rows), reverse=True), 2048)[2]) * 1.1


def test_packing_odd_words_tokenize_alike():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(1)
    pool = "aZ'sréÉ ßİıΣς́  \t\n9²½#<|endoftext|>|ŉdžDŽ漢字🙂\u001cªº×÷ it's'LL'Re"
    odd = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", "<|endoftext|> a<|startoftext|>b"]
    ids, total = packing.token_ids(pa.array(odd), path)
    at = 0
    for t, n in zip(odd, total, strict=True):
        assert list(ids[at : at + n]) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at += n


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


# line dedup


def test_lines_drop_templates(spark):
    rows = [(i, " ".join(f"{'abcdefghij'[i]}{c}" for c in "mnopqrst") + f"\nLicensed {2000 + i} to everyone") for i in range(10)]
    rows += [(20, rows[0][1]), (21, None), (22, ""), (None, "Licensed 1999 to everyone\nand a much longer line that stays with its document")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, k_id string")
    got = {r.doc_id: r for r in line_dedup.deduplicated(frame).collect()}
    assert len(got) == 14 and got[21].text is None and got[22].text == "" and set(got[0].asDict()) == {"doc_id", "text", "k_id", "dropped_lines"}
    for i in (*range(10), 20):
        assert "Licensed" not in got[i].text and got[i].text.count(" ") == 7 and got[i].dropped_lines == 1
    assert got[None].text == "and a much longer line that stays with its document"


def test_lines_generalise_what_varies_in_a_leaf(spark):
    names = "ann bob cid dan eve fay gus hal".split()
    rows = [(i, f"Posted in news by {n} on the web site\n" + " ".join(f"{n}{chr(97 + k)}" for k in range(20))) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.dropped_lines for r in line_dedup.deduplicated(frame).collect()} == {1}


def test_lines_of_boilerplate_go_from_pages_that_are_little_else(spark):
    line = "we use cookies on this site to improve what you see"
    rows = [(i, f"page {'abcdefghij'[i]}\n{line}") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.dropped_lines, r.text.count("\n")) for r in line_dedup.deduplicated(frame).collect()} == {(1, 0)}


def test_lines_of_two_families_that_start_alike(spark):
    names = [a + b for a in ("ann", "bob", "cid", "dan") for b in ("my", "ja", "ko")]
    ends = ("on our site today", "in the latest news")
    rows = [(i, f"Read more about {n} {ends[i % 2]}\n" + " ".join(f"{n}{chr(97 + k)}{i}" for k in range(20))) for i, n in enumerate(names)]
    rows += [(50 + i, f"Read more about {n} whatever comes after this\n" + " ".join(f"{n}{chr(97 + k)}z" for k in range(20))) for i, n in enumerate(names[:3])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.dropped_lines for r in line_dedup.deduplicated(frame).collect()}
    assert all(got[i] == (1 if i < 50 else 0) for i in got)


def test_lines_take_long_texts_and_clashing_columns(spark):
    footer = "this is the footer of every page here"
    rows = [(i, "\n".join(f"{'abcdefgh'[i]}w{chr(97 + k % 26)}{k} long" for k in range(5000)) + "\n" + footer, 7, "each") for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, dropped_lines int, places string")
    got = line_dedup.deduplicated(frame).collect()
    assert all(footer not in r.text and r.text.count("\n") == 4999 and r.dropped_lines == 1 and r.places == "each" for r in got)


def test_lines_of_fields_alone_are_not_templates(spark):
    """Tables, dates and figures of unrelated texts stay; a row that recurs as it is goes."""
    rows = [(i, "\n".join(f"{'abcdefgh'[i]}{c}word of its own" for c in "pqrst") + f"\n{i}.5 {i * 7 + 1} {i + 100}\n2024-01-0{i + 1} total {i}\n1 2 3 4") for i in range(8)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.text for r in got} == {t.removesuffix("\n1 2 3 4") for _, t in rows} and {r.dropped_lines for r in got} == {1}


def test_navigation_goes_from_pages_that_are_mostly_navigation(spark):
    nav = "home news sport weather shop help log in\nabout us contact jobs press terms privacy cookies\nfollow us on all the usual channels for more of this"
    for own in (60, 20, 8):
        rows = [(i, nav + "\n" + " ".join(f"{'abcdefghij'[i]}{a}{b}" for a in "klmnopqr" for b in "stuvwxyz")[: own * 4 - 1]) for i in range(10)]
        got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r.dropped_lines for r in got} == {3} and all(nav not in r.text for r in got)


def test_near_copies_that_lost_a_line_each_stay_whole(spark):
    line = lambda k: " ".join(f"{'abcdefghijkl'[k]}{c}" for c in "mnopqrst")
    rows = [(i, "\n".join(line(k) if k != i else f"changed here {'abcdefghijkl'[i]}" for k in range(12))) for i in range(12)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.dropped_lines for r in got} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_lines_agree_with_sql_on_popular_templates(spark, seed):
    """Texts of which many are copies and near copies, and lines that many of them share."""
    import duckdb

    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice(["", "x", "7", "@y"])
    popular = [" ".join(word() for _ in range(rng.randrange(1, 10))) for _ in range(12)]
    family = [[rng.choice([rng.choice(popular), " ".join(word() for _ in range(7))]) for _ in range(9)] for _ in range(6)]
    rows = []
    for i in range(160):
        kind = rng.randrange(3)
        lines = list(rng.choice(family)) if kind else [" ".join(word() for _ in range(8)) for _ in range(rng.randrange(5))]
        for _ in range(rng.randrange(3) if kind < 2 else 0):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([rng.choice(popular), " ".join(word() for _ in range(6))]))
        rows.append((i, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    name = "op5_log_template_line_dedup"
    want = {tuple(r) for r in con.sql(f"SELECT doc_id, n_dropped FROM ({line_dedup.ORACLE_SQL[name]})").fetchall()}
    assert {(r.doc_id, r.dropped_lines) for r in line_dedup.deduplicated(frame).collect()} == want and len({n for _, n in want}) > 2


def test_lines_leave_copies_whole(spark):
    body = "\n".join(f"line {c} of a text that many have" for c in "abcdefgh")
    rows = [(i, body + f"\n{'pqrstuvw'[i]}") for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.dropped_lines for r in line_dedup.deduplicated(frame).collect()} == {0}


def test_lines_go_from_short_texts_and_copies_too(spark):
    footer = "subscribe to our letter for more of this kind every week"
    rows = [(i, " ".join(f"{'abcdefghij'[i]}{c}{d}" for c in "mnopq" for d in "rstu") + "\n" + footer) for i in range(10)]
    rows += [(20 + i, f"only {'abcdefgh'[i]}\n" + footer) for i in range(8)]
    body = "\n".join(f"line {c} of a text that many have" for c in "abcdefgh")
    rows += [(40 + i, body + f"\n{'pqrstuvw'[i]}\n" + footer) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicated(frame).collect()}
    assert all(got[i].text == t.removesuffix("\n" + footer) and got[i].dropped_lines == 1 for i, t in rows)


def test_lines_of_a_large_group_of_copies_stay(spark):
    rng = random.Random(5)
    body = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(rng.randrange(4, 20))) for _ in range(40)]
    rows = [(i, "\n".join(x for x in body if rng.random() < 0.8) + "\n" + " ".join(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}{c}" for c in "klm")) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.dropped_lines for r in line_dedup.deduplicated(frame).collect()} == {0}


def test_lines_of_copies_with_a_word_changed_in_each_stay(spark):
    rng = random.Random(6)
    body = [[rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(20)] for _ in range(3)]
    rows = [(i, "\n".join(" ".join("changed" + "abcdefghijkl"[i] if p == 3 + i else w for p, w in enumerate(x)) for x in body)) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.dropped_lines for r in line_dedup.deduplicated(frame).collect()} == {0}


def test_lines_empty(empty):
    assert line_dedup.deduplicated(empty).count() == 0


# decontamination


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


BENCH = [(1, "The quick, brown fox jumps over the lazy dog and then it sleeps"), (2, "Short item"), (3, None), (4, "..."), (12, "Où est l'élève ? Il est là-bas, près de l'ÉCOLE du village"), (2, "another short one")]
DOCS = [(1, "x The QUICK brown fox -- jumps over the lazy dog and y"), (2, "a short ITEM here; another short one, too"), (3, None), (4, ""), (5, "où est l élève il est là bas près de l"), (6, "the quick brown fox jumps over the lazy cat"), (7, "Short item Short item"), (None, "short\nitem")]


def test_contamination(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        decontaminate.BLOCK_BYTES, old = block, decontaminate.BLOCK_BYTES
        got = {r.doc_id: r.hits for r in decontaminate.contamination(docs, bench).collect()}
        decontaminate.BLOCK_BYTES = old
        for i, t in DOCS:
            w = item_words(t)
            hit, found = set(), set()
            for item, body in BENCH:
                v = item_words(body)
                for s in range(max(1, len(v) - 9) if v else 0):
                    win = v[s : s + 10]
                    for p in range(len(w) - len(win) + 1):
                        if w[p : p + len(win)] == win:
                            hit |= set(range(p, p + len(win)))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))
            spanned = [x for s in got[i].spans for x in item_words(t[s.start : s.end])]
            assert spanned == [x for k, x in enumerate(w) if k in hit]
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 4, 6}


def test_contamination_of_long_texts_ties_and_clashing_columns(spark):
    item = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item), (2, item), (3, "q3 " * 40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "w " * 200_000 + item.upper() + " w" * 1000, 9), (2, "q3 " * 9, 9), (3, "q3 " * 11, 9)], "doc_id bigint, text string, hits int")
    got = {r.doc_id: r.hits for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[1].n_hit, got[1]["items"]) == (12, ["1", "2"]) and got[2].n_hit == 0 and (got[3].n_hit, got[3]["items"]) == (11, ["3"])


def test_contamination_empty(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    assert decontaminate.contamination(one, bench).first().hits.n_hit == 0


# near duplicates


def simhash_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    codes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def linked(codes):
    root = list(range(len(codes)))
    for a in range(len(codes)):
        for b in range(a):
            if root[a] != root[b] and (codes[a] ^ codes[b]).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_simhash(docs):
    rows = simhash.groups(docs).collect()
    want = Counter()
    codes = [simhash_of(t) for _, t, *_ in texts()]
    roots = linked(codes)
    low = {}
    for (i, *_), r in zip(texts(), roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    for (i, *_), c, r in zip(texts(), codes, roots, strict=True):
        want[(i, c, low.get(r))] += 1
    assert Counter((r.doc_id, r.code & (2**64 - 1), r.component_id) for r in rows) == want
    kept = simhash.deduplicated(docs).collect()
    assert len(kept) == len(set(roots)) and set(kept[0].asDict()) == set(docs.columns)


def test_links_among_dense_and_sparse_codes(spark):
    rng = random.Random(7)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(codes)[:6]:
        for _ in range(60):
            c = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                c ^= 1 << b
            codes.add(c)
    codes = sorted(codes)
    frame = spark.createDataFrame([(int(np.array(c, np.uint64).view(np.int64)),) for c in codes], "code bigint")
    got = {r.node & (2**64 - 1): r.root for r in simhash.components(simhash.links(frame)).collect()}
    want = linked(codes)
    parts = defaultdict(set)
    for c, r in zip(codes, want, strict=True):
        parts[r].add(got.get(c, c))
    assert all(len(x) == 1 for x in parts.values()) and len({x for p in parts.values() for x in p}) == len(parts)


@pytest.mark.parametrize("distance", [3, 4, 6])
def test_every_cut_of_a_fingerprint_finds_all_links(spark, distance):
    rng = random.Random(distance)
    centre = rng.getrandbits(64)
    codes = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 2))) for _ in range(150)}
    frame = spark.createDataFrame([(int(np.array(c, np.uint64).view(np.int64)),) for c in codes], "code bigint")
    codes = sorted(codes)
    near = [[(a ^ b).bit_count() <= distance for b in codes] for a in codes]
    part = list(range(len(codes)))
    for a in range(len(codes)):
        for b in range(a):
            if near[a][b] and part[a] != part[b]:
                part = [min(part[a], part[b]) if p in (part[a], part[b]) else p for p in part]
    for n in (10, 10**6, 10**8, 10**10):
        cut = simhash.segments(n, distance)
        assert sum(w for w, _ in cut) == 64 and sum(r + 1 for _, r in cut) == distance + 1
        found = simhash._links(simhash._bucket_rows(frame, cut).repartition(2, "bucket"), distance)
        got = {r.node & (2**64 - 1): r.root for r in simhash.components(found).collect()}
        assert len({(got.get(c, c), p) for c, p in zip(codes, part, strict=True)}) == len(set(part)) == len({got.get(c, c) for c in codes})


def test_links_of_one_large_bucket(spark):
    rng = np.random.default_rng(3)
    codes = np.unique((np.uint64(5) << np.uint64(51)) | rng.integers(0, 1 << 24, 20_000, dtype=np.uint64) | (rng.integers(0, 1 << 16, 20_000, dtype=np.uint64) << np.uint64(30)))
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code bigint")
    part = np.arange(len(codes))
    for k in range(len(codes)):
        near = np.bitwise_count(codes ^ codes[k]) <= 4
        parts = np.unique(part[near])
        if len(parts) > 1:
            part[np.isin(part, parts)] = parts[0]
    got = {r.node & (2**64 - 1): r.root for r in simhash.components(simhash.links(frame, most_stored=1500)).collect()}
    pairs = {(got.get(int(c), int(c)), int(p)) for c, p in zip(codes, part, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


def test_simhash_empty(empty):
    assert simhash.groups(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


# learned models


def test_quality_model_learns_and_holds_out(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["stone", "river", "green", "walks"]) for _ in range(40)) + ".", 1) for i in range(150)]
    bad = [(500 + i, " ".join(rng.choice(["WIN!!", "$$$", "###", "cash"]) for _ in range(40)), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(9999, None), (9998, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(None, 1, 0), (1, None, 0), (77777, 1, 0)], "doc_id bigint, quality int, toxic int")
    held = quality_model.held_out()
    model = quality_model.train(docs.where(~held), labels.where(~held))
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality_model.scored(F.col("text"), model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all(got[i] >= 0.5 for i, _, _ in good) and all(got[i] < 0.5 for i, _, _ in bad)


def test_quality_model_walk_is_that_of_a_plain_tree():
    rng = np.random.default_rng(0)
    x = rng.random((300, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_model.fit(x, y, trees=20, depth=3)
    for row, margin in zip(x, model.margin(x), strict=True):
        plain = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            plain += value[node - len(feature)]
        assert abs(plain - margin) < 1e-9
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_quality_model_is_the_same_for_repeated_ids(spark):
    rows = [(i % 20, f"text {'abcde'[i % 5]} " * (1 + i % 13)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    models = [quality_model.train(spark.createDataFrame(r, "doc_id bigint, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert all((a == b).all() for a, b in zip(models[0][1:], models[1][1:], strict=True))


def test_quality_model_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality_model.train(docs, none)
    assert docs.select(quality_model.scored(F.col("text"), model).alias("s")).agg(F.min("s")).first()[0] == 0.5
    assert empty.select(quality_model.scored(F.col("text"), model)).count() == 0


def test_language(docs):
    rows = language_id.identify(docs).select("doc_id", "text", "lang", language_id.held_out().alias("h"), "lang_id.lang", "lang_id.score").toDF("doc_id", "text", "lang", "h", "pred", "score").collect()
    for r in rows:
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.pred, r.score) == ("und", 0.0)
        else:
            assert r.pred in ("en", "fr", "de") and 0 <= r.score <= 1
    sure = [r for r in rows if r.doc_id is not None and r.doc_id < 60 and r.h]
    assert sum(r.pred == r.lang for r in sure) / len(sure) >= 0.95


def test_language_stage_keeps_clean_and_short_texts(docs, spark):
    strange = spark.createDataFrame([(500, "щщщ ыыы эээ юю жжж " * 40, None, "src0", 1, "", 1, "")], SCHEMA)
    before = docs.where("doc_id is not null")
    got = language_id.accepted(before.unionByName(strange))
    want = {i for i, t, *_ in texts() if i is not None and any(c.isalpha() for c in t or "")} - {108, 110}  # long texts like none of the languages
    assert {r.doc_id for r in got.collect()} == want and got.columns == docs.columns


def test_language_vectors_are_those_of_the_definition():
    text = "Ab, cé abc"
    got = language_id.bundles([text, None, "12"], np.arange(3), 3, 256)
    letters = re.sub(r"[^a-zé]+", " ", " " + text.lower() + " ")
    want = np.zeros(256)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b != " ":
            v = [language_id._letter_vector(ord(x), 256).astype(int) for x in (a, b, c)]
            want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    assert (got[0] == want).all() and not got[1:].any()


def test_language_without_training(empty, spark):
    assert language_id.identify(empty).count() == 0
    one = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert language_id.identify(one).first().lang_id.lang == "und"


# sharding


def test_shards(docs):
    rows = sharding.shard(docs, shards=4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in texts())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 4
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_under_a_hot_text(spark):
    rng = random.Random(4)
    rows = [(i, "x" * 400 if i % 3 == 0 else "".join(rng.choice("abc") for _ in range(rng.randint(200, 600)))) for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in found]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_shards_of_ties_under_hot_keys(spark):
    rows = [(i % 3, "y" * 50) for i in range(900)] + [(i, "z" * 50 + str(i)) for i in range(900)] + [(None, None)] * 5
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=4).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.15 * min(sizes.values())


def test_shards_empty(empty):
    assert sharding.shard(empty).count() == 0


# queries and pipeline


def test_every_numbered_query_is_registered():
    from doctree import llm

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES} == set(range(1, 11))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline_keeps_what_each_stage_should(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before) and all(set(after[i].text.split("\n")) <= set(before[i].text.split("\n")) for i in after)
        if name == "simhash_near_dedup":
            ids = sorted(before)
            roots = linked([simhash_of(before[i].text) for i in ids])
            assert set(after) == {min(i for i, r in zip(ids, roots, strict=True) if r == root) for root in set(roots)}
        if name == "decontamination":
            items = [item_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            wins = {tuple(w[s : s + 10]) for w in items for s in range(max(1, len(w) - 9))}
            for i, r in before.items():
                w = item_words(r.text)
                assert (i not in after) == any(tuple(w[p : p + n]) in wins for n in {len(x) for x in wins} for p in range(len(w) - n + 1))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def plain_hits(text, items, window=decontaminate.WINDOW):
    own, hit, found = item_words(text), set(), set()
    for item, body in items:
        theirs = item_words(body)
        size = min(window, len(theirs))
        windows = {tuple(theirs[k : k + size]) for k in range(len(theirs) - size + 1)} if theirs else set()
        for k in range(len(own) - size + 1):
            if size and tuple(own[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_windows_that_items_share(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcde")
    prompt = [word() for _ in range(14)]
    items = [(f"i{k % 17}", " ".join(prompt[: rng.randrange(15)] + [word() for _ in range(rng.randrange(12))])) for k in range(60)] + [("e", ""), ("n", "...")]
    machine = decontaminate.Machine(items, decontaminate.WINDOW)
    for _ in range(60):
        body = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(items)[1].split()
        n, runs, found = machine.scan(" ".join(body))
        assert (n, sum(b - a for a, b in runs), found) == plain_hits(" ".join(body), items)


def test_a_prompt_that_many_items_share_costs_no_more():
    import time

    prompt = "read the following passage with care and then answer the question that is asked below it"
    items = [(f"q{k}", f"{prompt} {' '.join(f'w{k}x{j}' for j in range(12))}") for k in range(100_000)]
    machine = decontaminate.Machine(items, decontaminate.WINDOW)
    text = " and so on ".join([prompt] * 20)
    machine.scan(text)
    began = time.perf_counter()
    n, runs, found = machine.scan(text)
    assert time.perf_counter() - began < 0.1  # most of it is the list of all items
    assert len(found) == 100_000 and sum(b - a for a, b in runs) == 20 * len(item_words(prompt))


def test_most_segments_have_balls():
    for n in (10, 1000, 10**6, 10**9, 10**11):
        for distance in (2, 3, 4, 5, 6):
            cut = simhash.segments(n, distance)
            assert 2 * sum(r > 0 for _, r in cut) >= len(cut) and sum(r + 1 for _, r in cut) == distance + 1
    codes = np.array([0, 7], np.uint64)
    rows = [(k, stored, len(np.unique(keys))) for k, keys, stored in simhash._keys(codes, [(22, 1), (21, 1), (21, 0)])]
    assert len(rows) == 23 + 22 + 1 and sum(stored for _, stored, _ in rows) == 3


def test_repeated_rows_are_drawn_in_proportion(spark):
    rows = spark.range(20_000).select(F.lit(5).cast("long").alias("key"), F.lit(10).cast("long").alias("size"), F.col("id").alias("row"))
    rows = rows.unionByName(spark.range(20_000).select(F.xxhash64("id").alias("key"), F.lit(10).cast("long").alias("size"), (F.col("id") + 20_000).alias("row")))
    chance = 4 * sharding.SAMPLES / 40_000
    drawn = [r.key for r in rows.where(F.pmod(F.xxhash64("row", "key", F.lit("sample")), F.lit(1 << 52)) / F.lit(float(1 << 52)) < chance).select("key").collect()]
    assert 30 < sum(k == 5 for k in drawn) < 100 and len(drawn) < 200
    assert len(sharding._splitters(rows, 400_000, 4)) <= 3


def test_copies_of_one_row_are_sharded(spark):
    frame = spark.createDataFrame([(1, "the same row")] * 500 + [(k, f"row {k}") for k in range(500)], "doc_id bigint, text string").repartition(4)
    rows = sharding.shard(frame).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 1000 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_tables_of_lines_are_sent_by_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_SENT", 1000)
    rows = spark.range(300).selectExpr("id % 100 AS leaf", "id AS line")
    narrow = spark.range(100).selectExpr("id AS leaf", "id + 1 AS n")
    wide = spark.range(100).selectExpr("id AS leaf", "transform(sequence(1, 30), i -> struct(i AS at, 'token' AS token)) AS constant")
    sent = lambda table: "strategy=broadcast" in str(line_dedup.found(rows, table, ["leaf"])._jdf.queryExecution().analyzed().toString())
    # A hundred rows either way; what is in their arrays counts.
    assert line_dedup.weight(narrow) == 100 and line_dedup.weight(wide) == 3100
    assert sent(narrow) and line_dedup.found(rows, wide, ["leaf"]).where("size(constant) = 30").count() == 300
