"""Version diff on small versions, against plain Python where the rule is a loop."""

from doctree.operators import diff

SCHEMA = "corpus_id string, doc_no string, name string, uuid string, body string"


def frame(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], SCHEMA)


BASE = [("A.1", "S", "u1", "x"), ("A.1.1", "Art", "u2", "x"), ("A.1.1.1", "Sec", "u3", "see [A.1.1.2 - Two](u4)"), ("A.1.1.2", "Two", "u4", "two"), ("A.1.1.2.1", "Kid", "u5", "k"), ("A.1.2", "Art2", "u6", "y"), ("A.1.2.1", "Gone", "u7", "z"), ("A.1.3", "Art3", "u8", "w")]
HEAD = [("A.1", "S", "u1", "x"), ("A.1.1", "Art", "u2", "x"), ("A.1.1.1", "Sec", "u3", "see [A.1.1.5 - Two](u4)"), ("A.1.1.5", "Two", "u4", "two"), ("A.1.1.5.1", "Kid", "u5", "k!"), ("A.1.2", "Art2", "u6", "y"), ("A.1.3", "Art3", "u8", "w"), ("A.1.3.1", "New", "u9", "n"), ("A.1.3.2", "No id", None, "m")]


def test_classes_and_stats(spark):
    base, head = frame(spark, BASE), frame(spark, HEAD)
    changes = diff.classify(base, head)
    got = {r.uuid: r.change for r in changes.collect() if r.uuid}
    assert got == {"u1": "same", "u2": "same", "u3": "xref_only", "u4": "number_only", "u5": "substantive", "u6": "same", "u7": "Deleted", "u8": "same", "u9": "Inserted"}
    living = diff.living_ancestors(base, head)
    assert [(r.uuid, r.head_no) for r in living.collect()] == [("u7", "A.1.2")]
    row = diff.stats(changes, living).first()
    assert (row.new, row.modified, row.removed, row.renumbered, row.number_only, row.total) == (1, 2, 1, 1, 1, 4)
    assert diff.renumbered(changes).count() == 0
    back = diff.stats(diff.classify(head.where("uuid is not null"), base), diff.living_ancestors(head, base)).first()
    assert back.removed == row.new and back.new == row.removed


def test_same_version_has_no_changes(spark):
    base = frame(spark, BASE)
    assert {r.change for r in diff.classify(base, base).collect()} == {"same"}


def test_scopes(spark):
    base, head = frame(spark, BASE), frame(spark, HEAD)
    changes, living = diff.classify(base, head), diff.living_ancestors(base, head)
    changed = diff.changed_numbers(changes, living)
    assert {r.doc_no for r in changed.collect()} == {"A.1.1.5.1", "A.1.2", "A.1.3.1", "A.1.3.2"}
    scopes = diff.edit_scopes(diff.scope_roots(changed), head)
    assert {(r.root_no, r.slug) for r in scopes.collect()} == {("A.1.1.5.1", "kid"), ("A.1.2", "art2"), ("A.1.3", "art3")}
    nodes = {(r.root_no, r.doc_no): (r.status, r.visible) for r in diff.scope_nodes(scopes, changes, living).collect()}
    assert nodes[("A.1.2", "A.1.2.1")] == ("Deleted", True) and nodes[("A.1.3", "A.1.3")] == (None, True) and nodes[("A.1.3", "A.1.3.1")] == ("Inserted", True)
    assert {r.root_no: r.summary for r in diff.scope_summary(scopes, changes, changed).collect()}["A.1.3"] == "1 edited document, 1 new document"
    assert {(r.root_no, r.doc_no, r.before) for r in diff.scope_siblings(scopes, head, changed).collect()} == {("A.1.2", "A.1.1", True), ("A.1.2", "A.1.3", False), ("A.1.3", "A.1.1", True)}


def plain_scopes(changed, docs):
    """The rule as a loop over sorted numbers."""
    key = lambda n: [(0, int(p), p) if p.isdigit() else (1, 0, p) for p in n.split(".")]
    above = lambda n: [n[:i] for i, c in enumerate(n) if c == "."]
    roots = [n for n in sorted(changed, key=key) if not set(above(n)) & set(changed)]
    groups = {}
    for n in roots:
        groups.setdefault(n.rpartition(".")[0], []).append(n)
    out = []
    for parent, members in groups.items():
        other = any(n.startswith(parent + ".") and n not in members for n in roots)
        out += [parent] if len(members) > 1 and not other and parent in docs else members
    return {n for n in out if not any(o != n and o.startswith(n + ".") for o in out)}


def test_scopes_agree_with_the_loop(spark):
    import random

    rng = random.Random(9)
    for _ in range(4):
        numbers = {"A.1"}
        while len(numbers) < 60:
            numbers.add(rng.choice(sorted(numbers)) + f".{rng.randint(1, 4)}")
        changed = set(rng.sample(sorted(numbers), 14)) | {"NR-1", "NR-2"}
        docs = [(n, f"name {n}", f"u{n}", "") for n in numbers | {"NR-1", "NR-2"}]
        head = frame(spark, docs)
        got = diff.edit_scopes(diff.scope_roots(spark.createDataFrame([("c", n) for n in changed], "corpus_id string, doc_no string")), head)
        assert {r.root_no for r in got.collect()} == plain_scopes(changed, numbers)


def test_slugs_and_labels(spark):
    rows = [("A.1", "One", "a", ""), ("A.2", "Two", "b", ""), ("A.1.1", "X", "c", ""), ("A.2.1", "x", "d", ""), ("A.2.2", "x 2", "e", "")]
    head = frame(spark, rows)
    scopes = diff.edit_scopes(spark.createDataFrame([("c", "A.1.1"), ("c", "A.2.1")], "corpus_id string, doc_no string"), head)
    assert {r.root_no: r.slug for r in scopes.collect()} == {"A.1.1": "x", "A.2.1": "x-2"}
    assert {r.root_no: (r.label, r.detail) for r in diff.scope_labels(scopes, head).collect()} == {"A.1.1": ("X", "One"), "A.2.1": ("x", "Two")}


def test_paragraphs_lines_tokens(spark):
    changes = diff.classify(frame(spark, [("A.1", "n", "u", "same\n\nold words here\n\ngone")]), frame(spark, [("A.1", "n", "u", "same\n\nold word here")]))
    found = diff.paragraphs(changes)
    assert [r.op for r in found.orderBy("place").collect()] == ["equal", "replace", "delete"]
    pairs = found.where("op = 'replace'")
    for kind in ("line", "token"):
        steps = diff.fine_diff(pairs, kind).orderBy("seq").collect()
        assert "".join(s.old_text for s in steps) == "old words here" and "".join(s.new_text for s in steps) == "old word here"
    assert diff.token_ops("a b c d e f", "a x c y e f") == [("equal", "a ", "a "), ("replace", "b c d", "x c y"), ("equal", " e f", " e f")]


def test_hunks(spark):
    text = "--- a\n@@ -1,2 +3,4 @@ x\n+y\n@@ -9 +20 @@\n@@ -5,1 +7,0 @@\n"
    ranges = diff.hunks(spark.createDataFrame([("c", text)], "corpus_id string, diff string"))
    assert {(r.first, r.after) for r in ranges.collect()} == {(2, 6), (19, 20)}
    spans = spark.createDataFrame([("c", "A", 0, 2), ("c", "B", 3, 18), ("c", "C", 20, 900)], "corpus_id string, doc_no string, line_start long, line_end long")
    assert {r.doc_no for r in diff.touched(spans, ranges).collect()} == {"A", "B"}


def merged_until_nothing_changes(ops, tokens):
    """The rule as it is told: a short equal run between two changes joins them, until there is none."""
    ops = list(ops)
    while True:
        for k in range(1, len(ops) - 1):
            short = ops[k][0] == "equal" and sum(1 for t in tokens[ops[k][1] : ops[k][2]] if t.strip()) <= diff.SHORT_RUN
            if short and ops[k - 1][0] != "equal" and ops[k + 1][0] != "equal":
                ops[k - 1 : k + 2] = [("replace", ops[k - 1][1], ops[k + 1][2], ops[k - 1][3], ops[k + 1][4])]
                break
        else:
            return ops


def test_token_runs_agree_with_the_rule():
    import difflib
    import random

    rng = random.Random(4)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 25))) for _ in range(2))
        x, y = diff._TOKEN.findall(a), diff._TOKEN.findall(b)
        want = [(op, "".join(x[i:j]), "".join(y[k:m])) for op, i, j, k, m in merged_until_nothing_changes(difflib.SequenceMatcher(None, x, y).get_opcodes(), x)]
        assert diff.token_ops(a, b) == want


def test_roundtrip_check(spark):
    schema = "corpus_id string, version_id string, text string"
    a = spark.createDataFrame([("a", "v", "x\ny"), ("b", "v", "x\ny\nz"), ("c", "v", "only")], schema)
    b = spark.createDataFrame([("a", "v", "x\ny"), ("b", "v", "x\nq\nz\nmore"), ("d", "v", "")], schema)
    got = {r.corpus_id: (r.equal, r.n_differing, r.first_line, r.first_a, r.first_b) for r in diff.roundtrip(a, b).collect()}
    assert got["a"] == (True, 0, None, None, None) and got["b"] == (False, 2, 2, "y", "q") and got["c"][:2] == (False, 1) and not got["d"][0]


def test_long_ranges_are_few_rows_and_overlaps_are_exact(spark):
    import random

    from doctree.operators import ranges

    rng = random.Random(3)
    long = spark.createDataFrame([(0, 10**8), (1, 10**8 + 1), (5, 5), (12345, 99_999_999)], "a bigint, b bigint")
    counts = {tuple(r)[0]: r["count"] for r in ranges.cover(long, "a", "b").groupBy("a").count().collect()}
    assert set(counts) == {0, 1, 12345} and all(n < 60 for n in counts.values())
    size = lambda: rng.choice([1, 2, 5, 40, 300])
    spans, at = [], 0
    for k in range(120):
        n = size()
        spans.append(("c" if k % 2 else "d", f"A.{k}", at, at + n - 1))
        at += n
    changed = [(rng.choice("cd"), a := rng.randrange(at + 50), a + rng.choice([0, 1, 3, 700])) for _ in range(25)]
    found = diff.touched(spark.createDataFrame(spans, "corpus_id string, doc_no string, line_start bigint, line_end bigint"), spark.createDataFrame(changed, "corpus_id string, first bigint, after bigint"))
    want = {(c, no) for c, no, s, e in spans for d, a, b in changed if c == d and s < b and a <= e and a < b}
    assert {tuple(r) for r in found.collect()} == want and 0 < len(want) < len(spans)
