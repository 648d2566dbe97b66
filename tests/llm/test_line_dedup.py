from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.line_dedup import BOTH, CLASSES, FEW, LEAST, MOST, PIECE, dedup_lines, line_blocks, line_groups, n_pieces, pieces
from test_decontam import WORD


def words(t):
    return WORD.findall((t or "").lower())


def signed(b, seed=42):
    return int(np.uint64(xxhash.xxh64_intdigest(b, seed)).view(np.int64))


def pieces_of(norm):
    out = []
    for w in norm.split(" "):
        if len(w.encode()) < LEAST:
            continue
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += "".join(c + " " if xxhash.xxh64_intdigest(c.encode(), 42) % 4 == 0 else c for c in w).strip(" ").split(" ")
    return list(dict.fromkeys(out))


def blocks_of(norm):
    """Majority bits of each class, None for an empty one."""
    votes = [[] for _ in range(CLASSES)]
    for x in pieces_of(norm):
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        votes[h & 3].append([h >> (2 + b) & 1 for b in range(16)])
    return [tuple((np.sum(v, axis=0) > len(v) // 2).tolist()) if v else None for v in votes]


def keys_of(norm):
    n, size = len(pieces_of(norm)), len(norm)
    out = set()
    if FEW <= n <= MOST:
        b = blocks_of(norm)
        out |= {(c, tuple(b[i] for i in c)) for c in combinations(range(CLASSES), CLASSES - 2) if any(b[i] is not None for i in c)}
    if not FEW + BOTH <= n <= MOST and size >= 10:
        for half in (size // 2, (size - 1) // 2):
            out |= {("front", norm[:half]), ("back", half, norm[size - half:])}
    return out


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def expected(rows):
    place, lines = {}, []
    for d, t in rows:
        th = signed(t.encode()) if t is not None else 42
        for pos, raw in enumerate(t.split("\n") if t is not None else []):
            if w := words(raw):
                norm, p = " ".join(w), (d is None, d or 0, th, pos)
                place[norm] = min(place.get(norm, p), p)
    norms = sorted(place)
    keys = [keys_of(n) for n in norms]
    parent = list(range(len(norms)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(norms)):
        for j in range(i + 1, len(norms)):
            a, b = norms[i], norms[j]
            most = max(len(a), len(b)) // 10
            if keys[i] & keys[j] and abs(len(a) - len(b)) <= most and edits(a, b, most) <= most:
                parent[find(i)] = find(int(j))
    first = {}
    for i, n in enumerate(norms):
        r = find(i)
        first[r] = min(first.get(r, place[n]), place[n])
    keep = {n: first[find(i)] for i, n in enumerate(norms)}
    out = Counter()
    for d, t in rows:
        if t is None:
            out[d, None, 0, 0] += 1
            continue
        th, left, cut = signed(t.encode()), [], t.split("\n")
        for pos, raw in enumerate(cut):
            w = words(raw)
            if not w or keep[" ".join(w)] == (d is None, d or 0, th, pos):
                left.append(raw)
        out[d, "\n".join(left), len(cut), len(cut) - len(left)] += 1
    return out


def test_against_all_pairs(both):
    got = Counter(tuple(r) for r in dedup_lines(both).collect())
    want = expected([tuple(r) for r in both.select("doc_id", "text").collect()])
    assert got == want and sum(k[3] for k in got.elements()) > 100


def test_fuzzy_lines_go(spark):
    line = " ".join(f"word{i:03d}" for i in range(200))
    rows = [(i, line.replace(f"word{7 * i:03d}", f"word{7 * i:03d}x") + "\nown line of number " + "abcdefghij"[i] * 9) for i in range(10)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in out.collect())
    assert got == expected(rows) and sum(k[3] for k in got.elements()) >= 5


def test_blocks_of_any_length(spark):
    rows = [(" ".join(f"word{i}" for i in range(n)),) for n in (1, 2, 3, 63, 300, MOST)] + [("日本語" * 40,), ("ab",)]
    df = spark.createDataFrame(rows, "norm string").select("norm", pieces(F.col("norm")).alias("pieces"))
    assert {r.norm: r.pieces for r in df.collect()} == {n: pieces_of(n) for n, in rows}
    got = {r.norm: r for r in line_blocks(df, ["norm"]).collect()}
    assert len(got) == len(rows) - 1  # one has no feature
    for n, in rows[:-1]:
        for c, want in enumerate(blocks_of(n)):
            lanes = int(np.uint64(np.int64(got[n][f"s{c}"])))
            if want is None:
                assert got[n][f"s{c}"] == -1
            else:  # bit 4 f + l of the votes is at place 16 l + f
                assert [lanes >> (16 * (b % 4) + b // 4) & 1 for b in range(16)] == [int(x) for x in want]


def random_lines(rng, words, count):
    letters = "abcdefghijklmnopqrstuvwxyz"
    if words:
        return [" ".join("".join(rng.choice(list(letters), int(rng.integers(2, 9)))) for _ in range(words)) for _ in range(count)]
    return ["".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, int(rng.integers(14, 120)))) for _ in range(count)]


def edited(rng, line):
    """One letter changed, left out or put in."""
    i = int(rng.choice([k for k, c in enumerate(line) if c != " "]))
    new = chr(0x4E00 + int(rng.integers(0, 3000))) if ord(line[0]) > 127 else "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
    kind = int(rng.integers(3))
    if kind == 0:
        return line[:i] + new + line[i + 1:]
    return line[:i] + (new if kind == 1 else "") + line[i + (kind == 2):]


def test_recall_of_one_edit(spark):
    """Lines of any length, and without blanks, beside a copy with one edit,
    against edit similarity alone."""
    rng = np.random.default_rng(8)
    rows, group = [], {}
    for words_ in (3, 5, 10, 13, 20, 50, 200, 0):
        for line in random_lines(rng, words_, 60):
            other = edited(rng, line)
            if words_ and len(line) < 10:
                continue
            for t in (line, other):
                group[len(rows)] = words_
                rows.append((len(rows), t))
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = Counter(group[r.doc_id] for r in out.collect() if r.n_removed)
    total = Counter(group.values())
    print({w: 2 * gone[w] / total[w] for w in total})
    assert all(2 * gone[w] >= 0.9 * total[w] for w in total)


def test_far_lines_stay(spark):
    """Lines that share half their text, or all words but a long one."""
    rows = [(i, "a line that begins like many others and ends with " + w * 9) for i, w in enumerate("bcdfghjk")]
    rows += [(20 + i, f"{w * 9} is what this line of the corpus begins with") for i, w in enumerate("bcdfghjk")]
    assert all(r.n_removed == 0 for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_empty_and_carried(odd, empty):
    assert dedup_lines(empty).count() == 0
    out = dedup_lines(odd, carry=odd.columns)
    assert Counter(r.rest.n for r in out.collect()) == Counter({1: odd.count()})


def test_a_round_without_pairs_is_not_the_last(spark):
    """Two close lines whose buckets have a far line as their first centre."""
    first = [r.id for r in spark.range(3).orderBy(F.xxhash64("id", F.lit(0))).collect()]
    text = {first[0]: "other text in a line", first[1]: "some line of words", first[2]: "some line of wordz"}
    lines = spark.createDataFrame([(i, 20, 7) for i in first], "id long, len int, bucket long")
    texts = spark.createDataFrame(list(text.items()), "line long, norm string")
    got = line_groups(lines, texts).collect()
    assert {r.id for r in got} == set(first[1:]) and len({r.component for r in got}) == 1


def test_features_of_mixed_lines(spark):
    """Long words among others, and the number of features where the first
    words do not show it."""
    short = [f"word{i}" for i in range(FEW + BOTH)]
    long = ["abcdefghijklmnop", "elcióncióndoraañ", "日本語の長い行です日本語の"]
    mixed = [short + long, long + short[:8], short[:5] * 20, ["word0"] * 200 + short, short[:-1] + ["abc"] * 99, long * 9, long * 9 + short,
             [f"word{i}" for i in range(MOST)], [f"{i:04x}" for i in range(MOST + 1)], ["ab"]]
    rows = [(" ".join(x),) for x in mixed]
    df = spark.createDataFrame(rows, "norm string")
    for r in df.select("norm", pieces(F.col("norm")).alias("p"), n_pieces(F.col("norm")).alias("n")).collect():
        want = pieces_of(r.norm)
        assert sorted(r.p) == sorted(want)
        assert r.n == len(want) or r.n == FEW + BOTH <= len(want) <= MOST


def test_long_lines_are_not_cut_twice(spark):
    """The number of features of a usual line is known from its first words."""
    line = " ".join(f"word{i}" for i in range(200))
    assert spark.createDataFrame([(line,)], "norm string").select(n_pieces(F.col("norm"))).first()[0] == FEW + BOTH


def test_lines_of_any_separators(spark):
    """Words and line numbers as they are in each line by itself."""
    texts = ["A b\tC\r\nd..E\n\n \x00 \n--\nf'g", "ΟΔΟΣ\nΟΔΟΣ x\nÀ, é", "\n", "", "a\u2028b\u0085c\n\x0b\x0ca", None]
    rows = [(i, t) for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in dedup_lines(df).collect()) == expected(rows)
