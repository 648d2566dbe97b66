import re
from collections import Counter, defaultdict

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.quality import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            rep |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep),
            len(w) < 20 or 100 * len(rep) > 30 * len(w))


def norm(line):
    return re.sub(rb"[0-9]+", b"0", b" ".join(line.encode().lower().split()))


def expected(rows, min_docs, share):
    docs, hosts = defaultdict(set), defaultdict(set)
    for d, t, h in rows:
        hosts[h].add(d)
        for line in (t or "").split("\n"):
            if WORD.search(line):
                docs[h, norm(line)].add(d)
    out = Counter()
    for d, t, h in rows:
        b = base(t)
        plate, stay = 0, []
        for line in (t or "").split("\n"):
            n = len(WORD.findall(line))
            m = len(docs[h, norm(line)]) if n else 0
            if m > min_docs and m > share * len(hosts[h]):
                plate += n
            else:
                stay.append(line)
        left = b[0] - plate
        out[d, *b, plate, not b[5] and left >= 20 and left >= 0.5 * b[0], None if t is None else "\n".join(stay)] += 1
    return out


def test_against_plain_counts(both):
    rows = [tuple(r) for r in both.select("doc_id", "text", "source").collect()]
    for min_docs, share in ((20, 0.02), (1, 0.0)):
        got = Counter(tuple(r) for r in quality(both, min_docs=min_docs, max_share=share).collect())
        want = expected(rows, min_docs, share)
        assert got == want
    assert any(r[7] for r in want)
    # the verdict is that of the text left, and the same without it
    bare = Counter(tuple(r) for r in quality(both, min_docs=1, max_share=0.0, with_text=False).collect())
    assert bare == Counter(r[:-1] for r in got.elements())
    assert all(len(WORD.findall(r[-1] or "")) == r[1] - r[7] for r in got)


def test_boilerplate_goes(spark):
    """A line that 30 documents of a host share goes there, and stays on
    another host; what is left of a short document is too little."""
    own = " ".join(a + b for a in "abcdef" for b in "vwxyz")
    name = [f"{a}{b}" for a in "qrs" for b in "abcdefghij"]  # digits are all alike
    rows = [(i, f"Menu 12 Home\n{own} {name[i]}\n\nmenu 7 home", "a") for i in range(30)] + [(90, f"menu 1 home\n{own}", "b"), (91, None, "a"), (92, "", "a")]
    rows += [(95, "menu 3 home \n" + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen", "a")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].text == f"{own} {name[3]}\n" and got[3].n_boilerplate == 6 and got[3].kept
    assert got[90].text == rows[30][1] and got[90].n_boilerplate == 0 and got[91].text is None and got[92].text == ""
    assert got[95].n_words == 21 and not got[95].base_failed and got[95].n_boilerplate == 3 and not got[95].kept


def test_empty(empty):
    assert quality(empty).count() == 0
