"""Arrangements against plain Python, and their way back."""

import hashlib

from quarrylake.llm import infill


def _plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TRICKY = ["a<P>b", "<", "<P", "S>", "<<S<M<P", "é\U0001F600‍\U0001F469 x\r\n \x00y", "P>" * 40, "<" * 40, "\U0001F600" * 33, "line\nline"]


def test_arranged(spark, docs, rows, nothing):
    more = [(100 + 7 * i + k, t, None, None, None, None) for i, t in enumerate(TRICKY) for k in range(0, 2000, 97)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    found = infill.restored(infill.arrange(table, keep=("id", "lang"))).collect()
    wanted = sorted((str(r[0]), *map(str, _plain(r[0], r[1]))) for r in [*rows, *more])
    assert sorted((str(r["id"]), str(r["n"]), r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in found) == wanted
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert sorted((str(r["id"]), r["restored"]) for r in found) == sorted((str(r[0]), r[1] or "") for r in [*rows, *more])
    assert "id_kept" in found[0].__fields__ and "lang" in found[0].__fields__
    assert infill.restored(infill.arrange(nothing)).count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = infill.restored(infill.arrange(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
