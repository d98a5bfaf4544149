"""Quality, toxicity, licenses, mixing, pages, search."""

import re
import zlib

import duckdb
import helpers as H
import numpy as np
import pytest

from aeroweave.llm import covertree, licenses, mixing, quality, queries, style_tree, toxicity


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    p, n = score[label == 1], score[label == 0]
    return ((p[:, None] > n[None, :]).mean() + 0.5 * (p[:, None] == n[None, :]).mean()) if len(p) and len(n) else 1.0


def base_statistics(text):
    w = H.WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if H.WORDS.search(x)]
    windows, twice = {}, set()
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k : k + 3]), []).append(k)
    for at in windows.values():
        if len(at) > 1:
            twice.update(k + d for k in at for d in range(3))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(twice), failed)


@pytest.mark.parametrize("where", ["small", "sf"])
def test_quality(spark, where):
    docs = H.documents(spark) if where == "small" else spark.read.parquet(f"{H.SF}/documents.parquet")
    rows = quality.quality_rules(docs, spark.read.parquet(f"{H.SF}/labels.parquet")).collect()
    want = {i: base_statistics(t) for i, t in H.plain(docs)}
    for r in rows:
        assert tuple(r)[1:7] == want[r["doc_id"]], r
        assert not (r["base_failed"] and r["kept"])
    assert len(rows) == docs.count()


def test_quality_is_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = ((x[:, 0] + 0.3 * rng.random(2000)) > 0.6).astype(float)
    forest = quality.train(x, y, (-1, 0))
    grid = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], axis=1)
    assert (np.diff(forest.score(grid)) <= 1e-12).all()
    forest = quality.train(x, y, (1, 0))
    assert (np.diff(forest.score(grid)) >= -1e-12).all() and auc(forest.score(x), y) > 0.9


def test_held_out_scores(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_noisy_channel_toxicity(spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert auc([r["score"] for r in held], [labels[r["doc_id"]]["toxic"] for r in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    clean = [r["predicted"] for r in held if not labels[r["doc_id"]]["toxic"]]
    assert sum(clean) <= 0.05 * len(clean)


def test_restoring():
    text = b"the stupid idiot said a stupid thing to another idiot " * 50
    model = toxicity.CharModel.of(toxicity.gram_counts([text]))
    assert model.restore("1d1ot") == "idiot" and model.restore("s.t.u.p.i.d") == "stupid"
    assert "idiot" in toxicity.Restorer(model).words("what an i d i o t he is")
    assert "stupid" in toxicity.Restorer(model).words("so stuuuupid")


def every_reading(model, seen):
    """The cost of the likeliest reading, over all readings, one by one."""
    t, best = toxicity, float("inf")
    todo = [(0, (0, 0, 0), "", 0.0)]
    while todo:
        i, (x, y, z), text, cost = todo.pop()
        if i == len(seen):
            best = min(best, cost + float(model.cost[x, y, z, 0]))
            continue
        c, ways = seen[i], []
        if c.isalpha():
            again = i > 0 and seen[i - 1] == c
            drawn = again and ((i > 1 and seen[i - 2] == c) or seen[i + 1 : i + 2] == c)
            ways = [(c, t.COST_KEEP_REPEAT if drawn else 0.0), *([("", t.COST_REPEAT)] if drawn else [])]
        else:
            ways = [(to, t.COST_LEET) for to in t.LEET.get(c, "")]
            ways += [("", t.COST_SEPARATOR if c not in t.LEET and c in t.SEPARATORS + " " else t.COST_DROP_SIGN), (" ", t.COST_BREAK)]
        for to, extra in ways:
            if not to:
                todo.append((i + 1, (x, y, z), text, cost + extra))
            elif to == " ":
                if text and text[-1] != " ":
                    todo.append((i + 1, (0, 0, 0), text + " ", cost + extra + float(model.cost[x, y, z, 0])))
            else:
                k = t.class_of(to)
                todo.append((i + 1, (y, z, k), text + to, cost + extra + float(model.cost[x, y, z, k])))
    return best


def cost_of(model, seen, reading):
    """The least cost at which ``seen`` gives ``reading``, spaces at its ends aside: all paths that spell it."""
    full = toxicity.CharModel(model.cost)
    costs = []

    def walk(i, context, at, cost, last):
        if i == len(seen):
            if reading[at:].strip() == "":
                costs.append(cost + float(full.cost[(*context, 0)]))
            return
        c = seen[i]
        t = toxicity
        if c.isalpha():
            again = i > 0 and seen[i - 1] == c
            drawn = again and ((i > 1 and seen[i - 2] == c) or seen[i + 1 : i + 2] == c)
            ways = [(c, t.COST_KEEP_REPEAT if drawn else 0.0), *([("", t.COST_REPEAT)] if drawn else [])]
        else:
            ways = [(to, t.COST_LEET) for to in t.LEET.get(c, "")]
            ways += [("", t.COST_SEPARATOR if c not in t.LEET and c in t.SEPARATORS + " " else t.COST_DROP_SIGN), (" ", t.COST_BREAK)]
        for to, extra in ways:
            if not to:
                walk(i + 1, context, at, cost + extra, last)
            elif to == " ":
                if last not in ("", " ") and (reading[at : at + 1] in (" ", "")):
                    walk(i + 1, (0, 0, 0), at + 1, cost + extra + float(full.cost[(*context, 0)]), " ")
            elif reading[at : at + 1] == to:
                k = t.class_of(to)
                walk(i + 1, (*context[1:], k), at + 1, cost + extra + float(full.cost[(*context, k)]), to)

    walk(0, (0, 0, 0), 0, 0.0, "")
    return min(costs)


def test_restoring_is_the_best_path():
    """No beam, no parts: the reading costs what the best of all readings costs, and runs of any length are one."""
    import random

    rng = random.Random(11)
    model = toxicity.CharModel.of(toxicity.gram_counts([b"you are an idiot and a liar , stop it now " * 20, b"the cat sat on the mat"]))
    for _ in range(150):
        seen = "".join(rng.choice("idot1!0$.- aa4") for _ in range(rng.randint(1, 9))).strip() or "a"
        want = every_reading(model, seen)
        assert cost_of(model, seen, model.restore(seen)) == pytest.approx(want, abs=1e-4), seen
    long = "stop.it.now." * 6 + "1d1ot"
    assert len(long) > 64 and toxicity.Restorer(model).reading(long).endswith("idiot")
    assert {"idiot", "idiots"} & toxicity.Restorer(model).words("you 1d107 1d1ot$")


def test_toxicity_small(spark):
    docs = H.documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(H.none(spark), labels).count() == 0
    assert quality.quality_rules(H.none(spark), labels).count() == 0


def base_places(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.low(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


@pytest.mark.parametrize("where", ["small", "sf"])
def test_licenses(spark, where):
    docs = H.documents(spark) if where == "small" else spark.read.parquet(f"{H.SF}/documents.parquet")
    want = {i: base_places(t) for i, t in H.plain(docs)}
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:6] == want[r["doc_id"]], r
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan_licenses(H.none(spark)).count() == 0


def test_license_rules(spark):
    cases = {
        1: ("Licensed under the Apache License, Version 2.0", "apache"),
        2: ("released under the GNU General Public License version 3", "gpl"),
        3: ("GNU Lesser General Public License", "gpl,lgpl"),
        4: ("SPDX-License-Identifier: MIT", "mit"),
        5: ("This is in the public domain", "public-domain"),
        6: ("a licence to drive", ""),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()} == {k: v for k, (_, v) in cases.items()}


def shortest(regex):
    """A text of the rule: no word that may be missing, of others the first."""
    regex = regex.replace("[12][90][0-9][0-9]", "1999").replace("[cs]", "c")
    while "(?:" in regex:
        regex = re.sub(r"\(\?:([^()|]*)[^()]*\)(\??)", lambda m: "" if m[2] else m[1], regex)
    return " ".join(regex.split())


def test_license_rules_alone(spark):
    """Every rule finds a text that holds nothing but its phrase."""
    rules = licenses.rules()
    docs = spark.createDataFrame([(r[0], shortest(r[5])) for r in rules], "doc_id long, text string")
    scan = licenses.scanned(docs)
    found = {(r["doc_id"], r["rule_id"]) for r in licenses.detections(scan).join(scan.select("rid", "doc_id"), "rid").collect()}
    assert not [r for r in rules if (r[0], r[0]) not in found]


def test_license_texts_without_stems(spark):
    cases = {
        1: ("Distributed under Apache 2.0", "apache"),
        2: ("Released under MPL 2.0", "mpl"),
        3: ("Published under Creative Commons Attribution 4.0", "cc-by"),
        4: ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        5: ("Released under CC0 1.0", "cc0"),
        6: ("in the public\ndomain", "public-domain"),
        7: ("No part of this publication may be reproduced", "reserved"),
        8: ("a commitment of some generality; disclosed", ""),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()} == {k: v for k, (_, v) in cases.items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{H.SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in queries.queries()[name](spark, H.SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    out, open_ = {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in open_}
            break
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("where", ["small", "sf"])
def test_mixing(spark, where):
    docs = H.documents(spark) if where == "small" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source, words = {}, {}
    for r in docs.collect():
        source[r["doc_id"]] = r["source"]
        words.setdefault(r["source"], []).append(len(H.WORDS.findall(r["text"] or "")))
    want = targets({s: sum(w) for s, w in words.items()})
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    taken = dict.fromkeys(words, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sum(words[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, w in words.items():
        assert abs(taken[s] - want[s]) <= 2 * max(w) + 1e-6, s  # less than a document; a repeated row counts twice
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)


def test_mixing_none(spark):
    assert mixing.mix_report(H.none(spark)).count() == mixing.mix(H.none(spark)).count() == 0


PAGE = """<html><head><title>t</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li>Menu</li></ul></nav>
<article><h1>Title {0}</h1><p>First   &amp; second&nbsp;part {0} of the story.</p><p>Another paragraph {0}<br>here.</p></article>
<aside class=sidebar>Side</aside><div class="comments"><p>Reader says</p></div><footer>Foot</footer></body></html>"""


def test_pages(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(k), "?") for k in range(20)] + [(90, None, None, "?"), (91, "x", "", "?"), (91, "x", "", "?")]
    out = {r["page_id"]: r for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k in range(20):
        text = out[k]["text"]
        assert text.startswith(f"Title {k}\n\nFirst & second part {k} of the story.\n\nAnother paragraph {k}"), text
        assert not any(x in text for x in ("Home", "Menu", "Side", "Reader", "Foot", "var x")) and out[k]["n_chars"] == len(text)
    assert out[90]["text"] == out[91]["text"] == "" and out[91]["n_chars"] == 0
    assert style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_importance(sources):
    """The tree of one host, by loops over its distinct pages."""
    import math
    from collections import defaultdict

    pages = [style_tree.Page(h) for h in sorted(set(sources))]
    m = len(pages)
    shows, says = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for page in pages:
        blocks = [b for b in page.merged() if not b[1]]
        for path in {b[0][:k] for b in blocks for k in range(1, len(b[0]) + 1)}:
            shows[path][frozenset(page.children.get(path, ()))] += 1
        for path, text in {(b[0], b[3]) for b in blocks}:
            says[path][text] += 1
    own = {}
    for path, seen in shows.items():
        presentation = -sum(k / m * math.log(k / m, m) for k in seen.values()) if m > 1 else 1.0
        found = [math.log(k, m) if m > 1 else 0.0 for k in says[path].values()]
        content = 1 - sum(found) / len(found) if found else 0.0
        own[path] = (m * max(presentation, content) + style_tree.PRIOR_PAGES) / (m + style_tree.PRIOR_PAGES)
    return {p: max(v * style_tree.DAMPING ** (len(q) - len(p)) for q, v in own.items() if q[: len(p)] == p) for p in own}


def plain_text(page, worth):
    blocks = [b for b in page.merged() if not b[1]]
    blocks = [b for b in blocks if b[2]] or blocks
    kept = [b for b in blocks if all(worth[b[0][:k]] >= style_tree.IMPORTANT for k in range(1, len(b[0]) + 1))]
    return "\n\n".join(b[3] for b in kept or blocks)


def site(host, pages):
    """Unmarked boilerplate inside articles and around the text of pages without one."""
    out = []
    for k in range(pages):
        body = "".join(f"<p>{host} {k} {j} text of its own</p>" for j in range(1 + k % 3))
        share = "<div><span>Tell your friends about this story</span></div>"
        if k % 2:
            html = f"<body><div><ul><li>Start<li>All stories</ul></div><article><h1>Title {k}</h1>{body}{share}</article></body>"
        else:
            html = f"<body><div><ul><li>Start<li>All stories</ul></div><table><tr><td><h1>Title {k}</h1>{body}</td></tr></table><section>Made with care</section></body>"
        out.append((k, f"http://{host}/{k}", html))
    return out


def check_pages(spark, rows):
    got = {(r["page_id"], r["url"]): r["text"] for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hosts, changed = {}, 0
    for _, url, source in rows:
        hosts.setdefault(style_tree.host_of(url), []).append(source or "")
    worth = {h: plain_importance(p) for h, p in hosts.items()}
    for ident, url, source in rows:
        page = style_tree.Page(source)
        want = plain_text(page, worth[style_tree.host_of(url)])
        assert got[ident, url] == want, (ident, url)
        changed += want != style_tree.main_text(page, frozenset())
    return got, changed


def test_tree_against_plain(spark):
    rows = [(1000 * n + k, url, html) for n, size in enumerate((1, 2, 5, 40)) for k, url, html in site(f"h{size}.org", size)]
    rows += [(9000, "http://h5.org/0", site("h5.org", 1)[0][2]), (9001, None, None)]
    got, changed = check_pages(spark, rows)
    assert changed >= 40
    assert got[3001, "http://h40.org/1"] == "Title 1\n\nh40.org 1 0 text of its own\n\nh40.org 1 1 text of its own"
    assert got[3002, "http://h40.org/2"].endswith("h40.org 2 2 text of its own") and got[3002, "http://h40.org/2"].startswith("Title 2")
    assert got[0, "http://h1.org/0"].startswith("Start") and got[9001, None] == ""


def test_tree_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{H.SF}/pages.parquet").select("page_id", "url", "html").collect()]
    check_pages(spark, rows)


@pytest.mark.parametrize("bucket_rows", [covertree.BUCKET_ROWS, 60])
def test_search(spark, monkeypatch, bucket_rows):
    """All queries against all pairs, with one bucket and with many."""
    monkeypatch.setattr(covertree, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).round(3).tolist()) for k in range(1500)]
    rows += [(1500, [float("nan")] * 8), (1600, None), (1700, [None] * 8), (2000, rows[3][1]), (2000, rows[3][1]), (None, rows[4][1])]
    rows += [(3000 + k, [1.0, float(k), 2.0]) for k in range(5)] + [(2**63 - 1, rows[5][1]), (100 * 2**40, [9e5] * 8), (100 * 2**40 + 1, [9e5 + 1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in covertree.top_products(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v and None not in v and not np.isnan(v).any()]
    asked = 0
    for at, (q, v) in enumerate(rows):
        if q is None or q % 100:
            continue
        best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0) for k, (i, w) in enumerate(rows) if k != at and len(w) == len(v))[:10]
        want = [(n, None if none else i, -s) for n, (s, none, i) in enumerate(best, 1)]
        assert sorted(found[q])[:: 2 if q == 2000 else 1] == want, q
        asked += 1
    assert asked == 19 and not {1500, 1600, 1700} & set(found)


def test_search_drops_what_it_may():
    """Vectors in groups: far fewer products than all, and the same scores."""
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(40, 16))
    points = np.floor(1024 * (heads[rng.integers(0, 40, 8000)] + 0.03 * rng.normal(size=(8000, 16)))).astype(np.int64)
    queries = points[::100]
    best = covertree.search(queries, np.arange(0, 8000, 100), covertree.build(points.astype(float)), points, np.arange(8000), np.zeros(8000, bool), np.arange(8000), 10)
    scores = queries @ points.T
    scores[np.arange(80), np.arange(0, 8000, 100)] = covertree.NONE
    assert (np.sort(scores, axis=1)[:, ::-1][:, :10] == best.score).all()
    assert best.products < 0.5 * scores.size
