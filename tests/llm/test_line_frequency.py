import re
from collections import Counter, defaultdict

from sparkloom.llm.line_frequency import MAX_DOCS, cleaned, op2_line_frequency, verdicts

SF = "/root/testdata/sf0.001"


def plain(rows, max_docs=MAX_DOCS):
    """(doc_id, text, source) -> verdicts, by loops."""
    texts_of = defaultdict(set)
    normal = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    for _, text, source in rows:
        for line in set(map(normal, (text or "").split("\n"))) - {""}:
            texts_of[source or "", line].add(text)
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        repeated = len({k + j for k, w in enumerate(windows) if w in twice for j in range(8)})
        worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        lines = [normal(x) for x in text.split("\n")]
        lost = sum(len(x.split(" ")) for x in lines if x and len(texts_of[source or "", x]) > max_docs)
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), repeated, failed, not failed and 2 * lost <= len(words), lost))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op2_equals_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert key(op2_line_frequency(spark, SF).collect()) == key(plain(rows))


LINE = "Click HERE  to accept cookies and go on reading this page with all of its many advertisements"


def fixture():
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, f"{own(k)}\n{LINE.upper() if k % 2 else LINE}\n{LINE}", "hot") for k in range(30)]  # depleted
    rows += [(100 + k, f"{LINE}\n{own(k)} {own(k + 500)} more", "hot") for k in range(5)]  # loses less than half
    rows += [(200, f"{LINE}\n{own(1)}", "cold"), (201, f"{LINE}\n{own(2)}", None), (202, None, None), (203, "", "hot"), (None, f"{LINE} {LINE}", "hot")]
    rows += [(300, "same text on many rows " * 1 + own(9) + " and six words more are here", "copies")] * 30
    rows += [(400, " ".join(["a b c d e f g h"] * 3000), "long"), (401, "\n".join(own(k) for k in range(3000)), "long"), (402, "   é#*\x0b$%&|<>\r\n" * 3, "odd")]
    return rows


def test_hot_lines_nulls_copies_and_long_texts(spark):
    docs = spark.createDataFrame([(a, b, c, "x") for a, b, c in fixture()], "doc_id long, text string, source string, kept string")
    got = key(verdicts(docs, 20).collect())
    assert got == key(plain(fixture(), 20))
    kept = {r[0]: r[7] for r in got}
    assert not any(kept[k] for k in range(30)) and all(kept[k] for k in (100, 104, 300)) and kept[200] is True


def test_cleaned_drops_lines_and_keeps_columns(spark):
    docs = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in fixture()], "doc_id long, text string, source string, line_nos string, held int")
    got = cleaned(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in plain(fixture()) if x[7])
    assert all("click here" not in r.text.lower() for r in rows if r.source == "hot")
    assert any("click here" in r.text.lower() for r in rows if r.source == "cold")
    assert {r.line_nos for r in rows} == {"x"}


def test_the_limit_does_not_grow_with_the_host(spark):
    """Over 10,000 rows, most of them copies of one text: a line of 21 distinct documents goes, one of 20 stays."""
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(25))
    rows = [(k, f"{own(k)}\n{LINE}", "hot") for k in range(21)] + [(100 + k, f"{own(k)}\nseen in twenty", "hot") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = spark.range(1000, 13_000).selectExpr("id AS doc_id", f"'{own(999)}' AS text", "'hot' AS source")
    got = {r.doc_id: r.n_lost_words for r in verdicts(docs.union(copies)).collect()}
    assert {got[k] for k in range(21)} == {len(LINE.split())} and {n for k, n in got.items() if k > 20} == {0}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert verdicts(docs).collect() == [] and cleaned(docs).collect() == []
