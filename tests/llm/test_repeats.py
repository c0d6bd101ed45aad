"""Near-duplicates, leaks and repeats against brute force, and the pipeline stage by stage."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strpack.llm import catalog, components, decontaminate, nearness, repeats, substrings, suffixes
from tests.llm.test_text import searched, wild

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(docs):
    out = {}
    for d, t in docs.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def linked(rows, numerator):
    """Component of every id: ids are linked if any of their texts are."""
    s = [(d, x) for (d, _), x in zip(rows, (sets({0: t})[0] for _, t in rows)) if x]
    at = {d: d for d, _ in rows}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[i + 1 :]:
            k = len(x & y)
            if a != b and 100 * k >= numerator * (len(x) + len(y) - k):
                u, v = root(a), root(b)
                at[max(u, v)] = min(u, v)
    return {d: root(d) for d in at}


def near_corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 150)]
    docs = {}
    for i in range(150):
        b = list(base[i % 2] if i < 120 else [rng.choice(vocabulary) for _ in range(40)])
        for _ in range(rng.randint(0, 5)):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        docs[i] = " ".join(b)
    return docs | {1000: "", 1001: "A b", 1002: "a\tB", 1003: "a b c d e", 1004: "  ", 1005: None, 1006: "a b c d e f " * 3000}


@pytest.mark.parametrize("numerator, block, best, few", [(85, 512, 16, 10**6), (80, 8, 1, 0)])
def test_groups_are_all_groups(spark, numerator, block, best, few):
    docs = near_corpus()
    rows = [*docs.items(), (3, docs[3]), (2000, docs[5]), (2000, "a text of its own that no other document has"), (2000, docs[1006]), (7, docs[8])]
    p = nearness.Params(numerator=numerator, block=block, best=best, broadcast_ids=few)
    got = nearness.groups(wild(spark, [*rows, (None, docs[3]), (None, None)]), p).collect()
    want, size = linked(rows, numerator), [(d, len(sets({0: t})[0])) for d, t in rows]
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(size)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id]), r
    assert nearness.groups(wild(spark).where("false"), p).count() == 0


def test_likely_pairs_of_blocks():
    """Each rule of emission against all likely pairs; groups don't mix; of crossed groups only the sides meet."""
    p, rng = nearness.Params(), np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    members = [np.unique(np.concatenate([base[: 400 - c], rng.integers(0, 1 << 63, c).astype(np.uint64)])) for c in rng.integers(0, 90, 40)]
    regs = nearness.sketch(np.concatenate(members), np.cumsum([0, *map(len, members)]), p)
    n, comp = np.array(list(map(len, members))), np.arange(40) // 4
    whole, no, plain = np.array([0]), np.array([False]), np.zeros(40, bool)
    pairs = lambda x, y: {*zip(x.tolist(), y.tolist())}
    x, y, more = nearness.chosen_pairs(whole, no, comp, n, regs, plain, 0, p)
    likely = pairs(x, y)
    j = nearness.joint_estimate(regs[:, None].repeat(40, 1).reshape(1600, -1), np.tile(regs, (40, 1)), np.repeat(n, 40).astype(float), np.tile(n, 40).astype(float)).reshape(40, 40)
    size = np.minimum(n[:, None], n) * 100 >= 85 * np.maximum(n[:, None], n)
    assert likely == {(a, b) for a in range(40) for b in range(a + 1, 40) if comp[a] != comp[b] and size[a, b] and j[a, b] >= p.limit} and not more.any()
    x, y, more = nearness.chosen_pairs(whole, no, comp, n, regs, plain, -1, p)
    assert len(x) < 10 and more.all() and pairs(x, y) <= likely
    x, y, more = nearness.chosen_pairs(whole, no, comp, n, regs, plain, 2, p)
    count = {}
    for u, v in zip(comp[x].tolist(), comp[y].tolist()):
        count[min(u, v), max(u, v)] = count.get((min(u, v), max(u, v)), 0) + 1
    assert more.all() and set(count.values()) <= {1, 2} and count.keys() == {(comp[a], comp[b]) for a, b in likely}
    side, start = np.arange(40) % 3 == 0, np.array([0, 1, 13, 30])
    cross = np.array([False, True, False, True])
    x, y, _ = nearness.chosen_pairs(start, cross, comp, n, regs, side, 0, p)
    of = np.searchsorted(start, np.arange(40), "right") - 1
    assert pairs(x, y) == {(a, b) for a, b in likely if of[a] == of[b] and (not cross[of[a]] or side[a] != side[b])}
    assert nearness._runs(np.cumsum([5, 1, 1, 9, 1]), 4) == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_registers_merge_and_estimate():
    p = nearness.Params()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:2700]
    k = [nearness.sketch(s, np.array([0, len(s)]), p) for s in (a, b, np.union1d(a, b))]
    assert (nearness.merge(k[0], k[1]) == k[2]).all()
    true = 1500 / 2700
    assert abs(nearness.joint_estimate(k[0], k[1], np.array([2000.0]), np.array([2200.0]))[0] - true) < 0.12
    same = nearness.joint_estimate(k[0], k[0], np.array([2000.0]), np.array([2000.0]))[0]
    assert same > 0.999


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_components_of_any_shape(spark, block):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    links = spark.createDataFrame([*path, *star, (7, 7), (200, 201), (201, 200), (200, 201), (None, 3)], "a long, b long")
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    got = components.components(links, block=block).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.components(links.where("false"), block=block).count() == 0


def test_leaks(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 40))) for i in range(12)} | {90: "too short", 91: None}
    docs = {}
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            passage = items[i % 12].split()
            if i % 2:
                passage[len(passage) // 2] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs[i] = " ".join(w).upper() if i % 6 == 0 else " ".join(w)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(wild(spark, [*docs.items(), (500, None), (500, None), (501, ""), (None, items[0])]), bench).collect()}
    want = {}
    for d, t in [*docs.items(), (None, items[0])]:
        w = WORD.findall(t.lower())
        for i, text in items.items():
            x = WORD.findall((text or "").lower())
            if len(x) < 5:
                continue
            s = {" ".join(x[k : k + 5]) for k in range(len(x) - 4)}
            for start in range(max(1, len(w) - len(x) + 1)):
                win = w[start : start + len(x)]
                g = {" ".join(win[k : k + 5]) for k in range(len(win) - 4)}
                both, every = sum(map(len, g & s)), sum(map(len, g | s))
                if every and 10 * both >= 8 * every:
                    want[d, i] = max(want.get((d, i), 0), round(both / every, 6))
    assert got == want and len(want) > 10
    docs_df = wild(spark, [*docs.items(), (None, items[0]), (None, "clean"), (501, "")])
    kept = {(r.doc_id, r.text) for r in decontaminate.clean(docs_df, bench).collect()}
    assert kept == {(d, t) for d, t in docs.items() if not any(d == k for k, _ in want)} | {(None, "clean"), (501, "")}
    plan = decontaminate.leaks(docs_df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert decontaminate.leaks(docs_df.where("false"), bench).count() == 0
    assert decontaminate.leaks(docs_df, bench.where("false")).count() == 0


def test_leaks_of_shifted_windows(spark):
    """Edits near an item's edge, and parts in another order: the best window is none that a shingle's place suggests."""
    items = {n: [f"word{i:02d}" for i in range(n)] for n in (13, 22, 32, 30, 100)}
    edited = {n: list(w) for n, w in items.items()}
    edited[13][0] = edited[22][1] = edited[32][2] = "different"
    del edited[30][2]
    edited[100] = items[100][50:] + items[100][:50]
    docs = [(n, " ".join([f"pre{i}" for i in range(20)] + w + [f"{'p' if n == 30 else 'post'}{i}" for i in range(20)])) for n, w in edited.items()]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.leaks(wild(spark, docs), bench).collect()}
    want = {}
    for d, t in docs:
        w = t.split()
        grams = lambda x: {" ".join(x[k : k + 5]) for k in range(len(x) - 4)}
        for n, x in items.items():
            for start in range(len(w) - n + 1):
                g, s = grams(w[start : start + n]), grams(x)
                both, every = sum(map(len, g & s)), sum(map(len, g | s))
                if 10 * both >= 8 * every and both / every > want.get((d, n), (0, 0))[1]:
                    want[d, n] = start, both / every
    assert got == {k: (a, round(b, 6)) for k, (a, b) in want.items()} and {(n, n) for n in items} <= {*want}


def repeat_corpus(alphabet, sizes, joint):
    rng = random.Random(2)
    shared = [joint.join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(10)] + [joint.join(["a"] * (sizes[-1] + 20)), joint.join(["a", "b"] * sizes[-1])]
    docs = {}
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.6 else joint.join(rng.choice("wxyz") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        docs[i] = joint.join(parts)
    return docs | {500: None, 501: "", 502: "é"}


def test_repeated_words(spark):
    docs = repeat_corpus([f"w{i}" for i in range(9)], [5, 13, 14, 30], " ")
    rows = [*docs.items(), (7, docs[7]), (None, docs[7])]
    first = {}
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    for d in sorted(docs):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    for r in substrings.digests(wild(spark, rows)).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        w, gone = words[r.doc_id], set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r.doc_id:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id
    assert substrings.digests(wild(spark).where("false")).count() == 0
    assert {r.doc_id: r.text for r in substrings.dedupe(wild(spark, [(0, "a  b"), (1, None)])).collect()} == {0: "a b", 1: ""}


def test_repeated_bytes(spark):
    docs = repeat_corpus("abcd é", [30, 150, 200, 201, 450], "")
    rows = [*docs.items(), (600, "q" + "unique" * 50)]
    rows.append(rows[-1])  # a repeated row is another occurrence
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, t in raw:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    want = {}
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        x = np.frombuffer(t, np.uint8)
        want[d] = (len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(x[~gone].tobytes()).hexdigest())
    got = suffixes.digests(wild(spark, rows)).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert suffixes.digests(wild(spark).where("false")).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(300)) + b"abcabcabc" * 20
    x, ends = np.frombuffer(data, np.uint8), np.full(len(data), len(data))
    sa, rank = suffixes.suffix_array(x, ends, len(data))
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    lcp = suffixes.kasai(x, ends, sa, np.ones(len(sa), bool), len(data))
    for p in range(1, len(sa)):
        a, b = data[sa[p - 1] :], data[sa[p] :]
        assert lcp[p] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_subtrees_split_by_longer_prefixes():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 3, 500), np.zeros(300, int), np.tile(rng.integers(0, 9, 20), 30)])
    at = np.arange(len(ids) - 12)
    windows = [tuple(ids[a : a + 13].tolist()) for a in at]
    for most in (1 << 16, 16):
        groups = list(substrings.partition(ids, at, most))
        assert sorted(np.concatenate([g for g, _ in groups]).tolist()) == list(range(len(at)))
        assert all(len(g) <= most or d == 13 for g, d in groups) and all(len({w[:d] for w in (windows[i] for i in g)}) == 1 for g, d in groups)
    for g, d in groups:
        order, common = substrings.subtree(ids, at[g], d)
        leaves = [windows[i] for i in g[order]]
        assert common[1:].tolist() == [next((k for k in range(13) if a[k] != b[k]), 13) for a, b in zip(leaves, leaves[1:])]
    classes = substrings.deep_nodes(ids, at)
    assert len(set(zip(windows, classes.tolist()))) == len(set(windows)) == len(set(classes.tolist()))


def test_words_are_numbered_by_their_bytes():
    words = [b"a", b"ab", b"", b"a", "é".encode(), b"ab"]
    ids = substrings.word_ids(np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words))))
    assert ids.tolist() == [0, 1, 2, 0, 3, 1] and len(substrings.word_ids(np.zeros(0, np.uint8), np.zeros(0, int))) == 0


def by_hand(module, docs, batches=3, n_bins=2):
    """The exchange of an operator without Spark, so that its parts can be replaced: {doc: (place, count) of windows}."""
    import pyarrow as pa

    spec, known, shards = module.SPEC, {}, iter(range(1 << 20))
    rows = [(d, 0, (t or "").encode()) for d, t in docs]
    parts = [rows[i::batches] for i in range(batches)]
    batch = lambda part, *more: pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary()), *more], names=["doc", "mark", "text", "place", "state"][: 3 + len(more)])

    def settled(records, function, *names):
        out = {}
        tables = [pa.Table.from_batches([r]) for r in records if r is not None]
        for b in range(n_bins):
            own = [t.filter(pa.compute.equal(t["bin"], b)) for t in tables]
            own = [t for t in own if t.num_rows]
            for r in function(pa.concat_tables(own), spec.ordered).to_pylist() if own else ():
                for k in names:
                    out.setdefault((r["doc"], k), []).append(r[k])
        return out

    found = settled([module.collect(batch(p), n_bins, known) for p in parts], repeats.settled_supers, "place", "state")
    held = [[r for r in p if (r[0], "place") in found] for p in parts]
    opened = [batch(p, *(pa.array([found[r[0], k] for r in p], pa.list_(pa.binary())) for k in ("place", "state"))) for p in held if p]
    flags = settled([w for b in opened for w in module.open_windows(b, n_bins, shards)], repeats.settled_windows, "place", "count")
    return {d: tuple(np.concatenate([np.frombuffer(x, np.int32) for x in flags[d, k]]) for k in ("place", "count")) for d, k in flags if k == "place"}


def removed(module, docs, **options):
    flags, out = by_hand(module, docs, **options), {}
    for d, t in docs:
        n = len(WORD.findall(t or "")) if module is substrings else len((t or "").encode())
        out[d] = np.flatnonzero(repeats.covered(n, module.SPEC.window, *flags[d])).tolist() if d in flags else []
    return out


def repeated_by_definition(module, docs):
    units = {d: WORD.findall(t or "") if module is substrings else (t or "").encode() for d, t in docs}
    w, at = module.SPEC.window, {}
    for d, u in units.items():
        for i in range(len(u) - w + 1):
            at.setdefault(tuple(u[i : i + w]) if module is substrings else u[i : i + w], []).append(d)
    out = {}
    for d, u in units.items():
        gone = set()
        for i in range(len(u) - w + 1):
            x = at[tuple(u[i : i + w]) if module is substrings else u[i : i + w]]
            if min(x) < d if module is substrings else len(x) > 1:
                gone.update(range(i, i + w))
        out[d] = sorted(gone)
    return out


def cases(module):
    sizes, alphabet, joint = ([5, 13, 14, 30], [f"w{i}" for i in range(9)], " ") if module is substrings else ([30, 150, 200, 201, 450], "abcd é", "")
    return [(d, t) for d, t in repeat_corpus(alphabet, sizes, joint).items()]


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_classes_inside_a_shard_decide(module, monkeypatch):
    """The suffix array and the suffix trees alone find repeats inside a shard: without them results are wrong. Hashes
    only bring records together: with eight bits of them results are right."""
    docs = cases(module)
    want = repeated_by_definition(module, docs)
    assert removed(module, docs) == want and removed(module, docs, batches=1, n_bins=1) == want
    rolling = repeats.Rolling.of
    monkeypatch.setattr(repeats.Rolling, "of", lambda self, a, b: rolling(self, a, b) & np.uint64(255) | (rolling(self, a, b) & np.uint64(255)) << np.uint64(32))
    assert removed(module, docs) == want
    monkeypatch.undo()
    if module is suffixes:
        monkeypatch.setattr(suffixes, "SHARD", 3000)  # several shards in a batch
        assert removed(module, docs) == want
        monkeypatch.undo()
        monkeypatch.setattr(suffixes, "string_classes", lambda x, ends, starts, length: np.arange(len(starts)))
    else:
        monkeypatch.setattr(substrings, "deep_nodes", lambda ids, at: np.arange(len(at)))
    assert removed(module, docs) != want


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_hot_passage_makes_no_hot_bin(module):
    """A passage in every document, in many batches: a bin gets about one record a batch for each of its anchors."""
    import pyarrow as pa

    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"{' '.join(rng.choice('abcdefgh') + str(rng.randint(0, 99)) for _ in range(40))} {passage} {' '.join(rng.choice('xyz') + str(rng.randint(0, 99)) for _ in range(40))}") for i in range(600)]
    assert removed(module, docs, batches=30, n_bins=3) == repeated_by_definition(module, docs)
    known, shown = {}, {}
    for k in range(30):
        part = docs[k * 20 : k * 20 + 20]
        out = module.collect(pa.record_batch([pa.array([d for d, _ in part], pa.int64()), pa.array([0] * 20, pa.int32()), pa.array([t.encode() for _, t in part], pa.binary())], names=["doc", "mark", "text"]), 1, known)
        r = repeats.read(out, repeats.SUPER)
        for a in r["anchor"][r["state"] >= repeats.SHOWN].tolist():
            shown[a] = shown.get(a, 0) + 1
    assert max(shown.values()) <= 30 + 2 * repeats.CROWD


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_rows = lambda pdf: sorted(repr([None if v is None or v != v else v for v in r]) for r in pdf[columns].astype(object).itertuples(index=False))
    assert as_rows(got) == as_rows(want)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = catalog.table(spark, sf, "documents")
    extra = [(10_000, "1234 !!", "en", "s", 7), (10_001, None, "en", "s", 0), (10_002, docs.where("length(text) > 400").first().text, "en", "s", 1)]
    at = docs.union(spark.createDataFrame(extra, docs.schema)).cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "tokens":
            assert at.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()} | {d: t for d, t, *_ in extra}
    gone = set(texts) - kept["language"]
    assert {d for d, t in texts.items() if not re.search(r"[^\W\d_]", t or "")} <= gone
    assert all(len(set(texts[d].split())) < 8 for d in gone if texts[d])  # and junk of one word
    left = {d: texts[d] for d in kept["language"]}
    assert kept["near_duplicates"] == {d for d, c in linked([*left.items()], 80).items() if c == d}
    found = {r.doc_id for r in decontaminate.leaks(docs.where(F.col("doc_id").isin([*kept["near_duplicates"]])), catalog.table(spark, sf, "benchmark")).collect()}
    assert kept["leaks"] == kept["near_duplicates"] - found and kept["secrets"] == kept["tokens"] == kept["leaks"]
    import tokenizers

    other = tokenizers.Tokenizer.from_file(catalog.vocabulary())
    for r in at.collect():  # secrets are out of the texts, and tokens are those of what is left
        text = redacted_by_search(left[r.doc_id])
        assert r.ids == other.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def redacted_by_search(text):
    """Overlapping matches of all kinds become one mark."""
    out, at, spans = [], 0, []
    for a, b, _ in sorted(searched(text)):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in spans:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def test_stages_on_wild_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = catalog.table(spark, sf, "documents")
    text = docs.where("length(text) > 400").first().text
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (2, "", "en", "s", 0), (3, text, None, None, None), (3, text + " more", "en", "s", 2), (4, text, "en", "s", 1)]
    table = docs.limit(60).union(spark.createDataFrame(rows, docs.schema)).withColumns({"n": F.lit(1), "rep": F.lit(2), "component_id": F.lit("x"), "h": F.lit(0)})
    for at in (table, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf)
            got = at.collect()
            if name != "tokens":
                assert at.columns == docs.columns
            if name == "near_duplicates" and got:
                assert sum(r.doc_id is None for r in got) == 1 and not any(r.doc_id == 4 for r in got)
