from __future__ import annotations

import random

from attest.llm.line_templates import drop_recurring_lines

SCHEMA = "doc_id long, text string, n_chars long, n_lines string, id int, key_ int"


def run(spark, rows, **kw):
    full = [(i, t, len(t) if t is not None else None, "x", 1, 2) for i, t in rows]
    return drop_recurring_lines(spark.createDataFrame(full, SCHEMA), **kw)


LONG = "the quick brown fox jumps over the lazy dog while " + " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz")


def test_first_document_keeps_the_line(spark):
    out = {r.doc_id: r for r in run(spark, [(1, f"own one\n{LONG}"), (2, f"{LONG}\nown two"), (3, "nothing shared in this line at all")]).collect()}
    assert out[1].text.endswith(LONG) and out[1].n_dropped == 0
    assert out[2].text == "own two" and out[2].n_dropped == 1 and out[2].n_chars == 7
    assert out[3].n_dropped == 0


def test_variable_fields_and_halves(spark):
    a = "served from cache number 17 at host alpha for user bob on the first of may"
    b = "served from cache number 99 at host alpha for user bob on the first of may"
    c = "served from cache number 4 at host beta by admin sue in a late week now"
    half = "served from cache number 4 at host alpha for nobody knows who it may have been"
    out = {r.doc_id: r.n_dropped for r in run(spark, [(1, a), (2, b), (3, c.replace("served", "sent")), (4, half)]).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 0}  # a half of its own stays


def test_short_lines_repeats_within_and_white_space(spark):
    rows = [(1, "too short to judge\n" * 3 + LONG + "\n" + LONG), (2, "too short to judge\r\n\t" + LONG.replace(" ", "  ") + " ")]
    out = {r.doc_id: r for r in run(spark, rows).collect()}
    assert out[1].n_dropped == 0
    assert out[2].n_dropped == 1 and out[2].text == "too short to judge\r"


def test_odd_rows(spark):
    rows = [(1, LONG), (1, LONG), (None, LONG), (None, "a b c d e f g"), (5, None), (6, ""), (7, "x" * 100_000 + " 1 2 3 4 5 6")]
    out = run(spark, rows).collect()
    assert len(out) == len(rows)
    assert [r.n_dropped for r in out if r.doc_id == 1] == [0, 0]
    assert sorted(r.n_dropped for r in out if r.doc_id is None) == [0, 1]
    assert [(r.text, r.n_lines) for r in out if r.doc_id == 5] == [(None, 0)]
    assert [(r.text, r.n_lines) for r in out if r.doc_id == 6] == [("", 1)]
    assert run(spark, []).collect() == []
    assert run(spark, rows).columns == ["doc_id", "text", "n_chars", "id", "key_", "n_lines", "n_dropped"]


def test_min_docs(spark):
    rows = [(i, LONG) for i in range(3)]
    assert sum(r.n_dropped for r in run(spark, rows[:2], min_docs=3).collect()) == 0
    assert sum(r.n_dropped for r in run(spark, rows, min_docs=3).collect()) == 2


def test_unique_parts_stay(spark):
    """Lines that share one half with another document's line each way, and rows of numbers, are texts of their own."""
    both = "the board met in the main hall on monday and then fired everybody at once quietly"
    first = "the board met in the main hall on monday and chose Ann as chair of works"
    last = "the board met by chance in a small inn late and then fired everybody at once quietly"
    rows = [(1, first), (2, both), (3, last), (4, "1 2 3 4 5 6 7 8"), (5, "1 2 3 4 5 6 7 9"), (6, "2001 7 a 8 9 b 10 11"), (7, "2002 7 a 8 9 b 10 12"), (8, "1 2 3 4 5 6 7 8")]
    assert {r.doc_id: r.n_dropped for r in run(spark, rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1}


def test_short_lines_recur_from_ten_documents_on(spark):
    rows = [(i, f"own {'x' * i} text\nAll rights reserved.\nOK then") for i in range(10)]
    assert [r.n_dropped for r in sorted(run(spark, rows).collect())] == [0] + [1] * 9
    assert sum(r.n_dropped for r in run(spark, rows[:9]).collect()) == 0


def test_for_each_dropped_line_one_of_its_template_stays(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(rng.choice([7, 12, 16, 40]))] for _ in range(12)]
    rows = []
    for i in range(300):
        line = list(rng.choice(base))
        for at in rng.sample(range(3, len(line)), rng.choice([0, 1, 2])):
            line[at] = rng.choice(["x1", "new", "other", "more"])
        rows.append((i, " ".join(line)))
    out = {r.doc_id: r for r in run(spark, rows).collect()}
    kept = [t.split() for i, t in rows if not out[i].n_dropped]

    def near(a, b):
        different = [i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y]
        return len(a) == len(b) and a[:3] == b[:3] and (not different or different[-1] - different[0] < -(-(len(a) - 3) // 4))

    gone = [t.split() for i, t in rows if out[i].n_dropped]
    assert len(gone) > 100 and all(any(near(g, k) for k in kept) for g in gone)
    assert len({tuple(k) for k in kept}) == len(kept)  # equal lines choose the same template, so no line is there twice


def test_many_lines_of_a_long_text(spark):
    lines = [f"line {'a' * (i % 97)} of the {'b' * (i // 97)} long shared text" for i in range(30_000)]
    own = [f"an own one {'c' * (i % 89)} of this {'d' * (i // 89)} text alone" for i in range(30_000)]
    mixed = [x for pair in zip(lines, own, strict=True) for x in pair]
    out = {r.doc_id: r for r in run(spark, [(1, "\n".join(lines)), (2, "\n".join(mixed))]).collect()}
    assert out[1].n_dropped == 0 and out[2].n_dropped == 30_000 and out[2].text == "\n".join(own)
