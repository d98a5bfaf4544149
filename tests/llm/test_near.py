"""Near duplicates and repeated lines against all pairs."""

import time
import zlib

import corpus_pipeline
import helpers as H
import numpy as np
import pyarrow as pa

from aeroweave.llm import components, linededup, minhash


def groups(texts):
    sets = [H.shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return [(i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(texts, sets, strict=True))]


def check(docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(groups(H.plain(docs)), key=order)


def test_small(spark):
    check(H.documents(spark))
    kept = minhash.without_duplicates(H.documents(spark))
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14] and kept.columns == H.SHAPE.names


def test_tables(spark):
    check(spark.read.parquet(f"{H.SF}/documents.parquet"))


def test_hot_list(spark):
    """Chains and stars of copies, more than a short list holds."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(400):
        words = list(base)
        words[k % 60] = f"odd{k}"
        rows.append((k, " ".join(words), "x", "s", 0, *["?"] * 11))
    rows += [(1000 + k, " ".join(f"own{k}_{i}" for i in range(30)), "x", "s", 0, *["?"] * 11) for k in range(100)]
    check(spark.createDataFrame(rows, H.SHAPE))


def test_pairs_of_lists_once(spark):
    """Two classes of different components that meet in 20 lists are one candidate, not 20."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[:150], *[f"own{k}_{i}" for i in range(30)]]), "x", "s", 0, *["?"] * 11) for k in range(6)]
    join = minhash.Join(spark.createDataFrame(rows, H.SHAPE))
    tokens = join.classes.selectExpr("cls", "cls as comp", "explode(sequence(1L, 20L)) as token")
    found = [tuple(r) for r in join.across(tokens).collect()]
    assert len(found) == len(set(found)) == 15
    assert {tuple(r) for r in join.across(tokens, once=False).collect()} == set(found)


def test_empty(spark):
    assert minhash.near_duplicates(H.none(spark)).count() == linededup.deduplicated(H.none(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 2000), (5, 5)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 2000: 1000}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        for most in (1, 2, 3):
            assert linededup.distance(a, b, most) == min(edit(a, b), most + 1), (a, b, most)


def plain_removed(texts):
    lines = sorted({(i, k, line) for i, t in texts for k, line in linededup.long_lines(t)}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    distinct = {}
    for i, k, line in lines:
        distinct.setdefault(line, (i, k))
    names = list(distinct)
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, a in enumerate(names):
        for b in names[:x]:
            if abs(len(a) - len(b)) <= 2 and len(set(a) ^ set(b)) <= 4 and root(a) != root(b) and linededup.distance(a, b, 2) <= 2:
                one, two = root(a), root(b)
                first = min((one, two), key=names.index)
                parent[one] = parent[two] = first
    return {(i, k) for i, k, line in lines if distinct[root(line)] != (i, k)}


def check_lines(docs):
    texts = H.plain(docs)
    gone = plain_removed(texts)
    want = sorted((i if i is not None else -1, "\n".join(p for k, p in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None) for i, t in texts)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["clean"]) for r in linededup.deduplicated(docs).collect())
    assert str(got) == str(want)
    return gone


def test_lines_small(spark):
    assert check_lines(H.documents(spark)) >= {(11, 1), (2, 0)}


def test_lines_tables(spark):
    assert check_lines(spark.read.parquet(f"{H.SF}/documents.parquet"))


def test_lines_hot(spark):
    """More lines that share a segment than a short list holds."""
    head = "this is the licence of the programme that everybody shares "
    rows = [(k, head + f"{k * 37 % 1000:04d} {k * k % 9973:05d} tail {k % 7}", "x", "s", 0, *["?"] * 11) for k in range(500)]
    check_lines(spark.createDataFrame(rows, H.SHAPE))


def test_lines_keep_rows_of_one_id_apart(spark):
    """Rows without an id, and of one id, lose their own repeated lines only."""
    long = [f"line {k} " + "of a text that stands nowhere else at all " + chr(97 + k) * 9 for k in range(8)]
    rows = [(None, f"{H.LINE}\n{long[0]}"), (None, f"{long[1]}\n{H.LINE}"), (None, f"{long[2]}\n{long[3]}\n{long[4]}"), (7, f"{long[5]}\n{H.LINE}"), (7, f"{long[6]}\n{long[7]}")]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [t if k == 0 else "\n".join(p for p in t.split("\n") if p != H.LINE) for k, (_, t) in enumerate(rows)]
    assert sorted(r["clean"] for r in got) == sorted(want)
    assert sorted(r["n_removed"] for r in got) == [0, 0, 0, 1, 1]


def test_short_lines(spark):
    """Exact repeats of short lines go in op7 and in the pipeline, against a plain count of lines."""
    texts = [(1, "Wh the.\nab\n\nWh the. \n  ab\n"), (2, "Wh the.\nac\n\nnew"), (3, "a" * 39 + "\n" + "a" * 38 + "b"), (4, "a" * 39 + "\nab\r\nrest")]
    seen, want = set(), {}
    for i, t in texts:
        kept = []
        for line in t.split("\n"):
            if not line.strip() or line.strip() not in seen:
                kept.append(line)
            seen.add(line.strip())
        want[i] = "\n".join(kept)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["clean"] for r in linededup.deduplicated(docs, exact=1).collect()} == want
    assert {r["doc_id"]: r["text_crc32"] for r in linededup.report(docs).collect()} == {i: zlib.crc32(t.encode()) for i, t in want.items()}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, H.SF).collect()} == want


def test_components_in_one_task(spark, monkeypatch):
    """Few edges are united by one task, without rounds; both ways give the same."""
    import random

    draw = random.Random(3)
    edges = [(draw.randrange(-500, 500), draw.randrange(-500, 500)) for _ in range(450)]
    rows = spark.createDataFrame([*edges, (7, 7), (-(2**62), 2**62)], "a long, b long")
    written = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df, tag: written.append(tag) or cut(df, tag))
    few = sorted(map(tuple, components.components(rows).collect()))
    assert written == ["edges"]
    monkeypatch.setattr(components, "IN_ONE_TASK", 0)
    assert sorted(map(tuple, components.components(rows).collect())) == few
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert dict(components.components(chain).collect()) == dict.fromkeys(range(301), 0)


def posted(lines, edits, least, frequent=()):
    """(key, line, mark) that the lines, each a text of its own, are posted under."""
    batch = pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["text"])
    names = {h: line for line, h in zip(lines, linededup.line_hashes(lines)[:, 0].tolist(), strict=True)}
    out = pa.Table.from_batches(list(linededup._post(edits, least, np.array(sorted(frequent), np.uint64))(iter([batch]))))
    return [(k & (1 << 64) - 1, names[h], s) for k, h, s in zip(*(c.to_pylist() for c in out.columns), strict=True)]


def meetings(posts):
    met = {}
    for key, line, mark in posts:
        met.setdefault(key, []).append((line, bool(mark & linededup._PROBE)))
    return sorted(sorted(m) for m in met.values())


def test_keys_of_lines():
    """Keys of a whole batch meet as the substrings do that they stand for, in bands too."""
    import random

    draw = random.Random(11)
    lines = {"", "a", "\x00\x00", "\x00" * 9, "grüße 你好 \U0001f600" * 5}
    while len(lines) < 300:
        line = "".join(draw.choice("ab\x00é你\U0001f600") for _ in range(draw.randint(1, 90)))
        at = draw.randrange(len(line))
        lines |= {line, line[:at] + draw.choice("ab") + line[at + draw.randint(0, 1) :]}
    lines = sorted(lines - {""})
    for edits in (1, 2, 3):
        plain = []
        for line in lines:
            own = [(len(line), k, line[a:b]) for k, (a, b) in enumerate(linededup.segments(len(line), edits))]
            plain += [(key, line, 0) for key in own]
            for other in range(max(1, len(line) - edits), len(line) + 1):
                near = [(other, k, line[a:b]) for k, a, b in linededup.windows(len(line), other, edits)]
                plain += [(key, line, linededup._PROBE) for key in near if other < len(line) or key != own[key[1]]]
        posts = posted(lines, edits, 1)
        assert meetings(posts) == meetings(plain)
        frequent = {key for key, line, _ in posts if line == lines[7]}
        banded = posted(lines, edits, 1, frequent)
        assert not frequent & {key for key, _, _ in banded}
        assert len(banded) == len(posts) + (linededup.BANDS - 1) * sum(key in frequent for key, _, _ in posts)
        bands = [((key, b, mark & bits), line, mark) for key, line, mark in posts if key in frequent for b, bits in enumerate(linededup._BAND_BITS)]
        assert meetings(banded) == meetings([p for p in posts if p[0] not in frequent] + bands)


def test_counts_of_keys(monkeypatch):
    """The most frequent keys are counted whole while others are forgotten."""
    monkeypatch.setattr(linededup, "COUNTED_KEYS", 50)
    often = linededup._Often()
    for k in range(400):
        often.add([np.arange(10 * k, 10 * k + 10, dtype=np.uint64) + np.uint64(1000), np.arange(20, dtype=np.uint64)])
    often.sum_up()
    assert dict(zip(often.keys.tolist(), often.times.tolist(), strict=True)).items() >= dict.fromkeys(range(20), 400).items()


def test_posting_is_cheap():
    """CPU seconds a GB of text, divided by this machine's slowness as the check tool takes it."""
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(4000)]
    texts = ["\n".join(" ".join(draw.choices(words, k=16)) for _ in range(40)) for _ in range(2000)]
    ids = pa.array(range(len(texts)), pa.int64())
    rows = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], names=["doc_id", "text", "unit"])

    def once():
        began = time.process_time()
        for _ in linededup._read_lines(2, 40, 1)(iter([rows])):
            pass
        for _ in linededup._post(2, 40, np.empty(0, np.uint64))(iter([rows.select(["text"])])):
            pass
        took, began = time.process_time() - began, time.process_time()
        for _ in range(100):
            sum(range(50_000))
        return took / ((time.process_time() - began) * 10)

    assert min(once() for _ in range(3)) / (sum(map(len, texts)) / 1e9) < 150


def test_single_lines_are_not_joined(spark):
    """Only lines with copies or near copies are decided on; every text's lines are counted all the same."""
    texts = {1: f"{H.LINE}\n\nalone one", 2: f"{H.LINE}\r\ntwo", 3: H.LINE.replace("lazy", "lazi") + "\n", 4: "", 5: None, 6: "\n\n", 7: "grüße\n你好 \U0001f600 " * 20}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    decided = linededup.LineJoin(docs, exact=1).decisions().select("doc_id", "line", "keep").collect()
    lines = [(2, 0, False), (1, 0, True), (3, 0, False), *[(7, k, k == 1) for k in range(1, 20)]]
    assert sorted(map(tuple, decided)) == sorted(lines)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in linededup.report(docs).collect()}
    gone = [i for i, _, keep in lines if not keep]
    assert got == {i: (0 if t is None else len(t.split("\n")), gone.count(i)) for i, t in texts.items()}
