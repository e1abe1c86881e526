"""Deduplication, near neighbours and packing against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from sparkveil.llm import collision_search, graph, line_edit_join, packing, shingle_sets, simhash_trees, substring_levels, suffix_parsing
from sparkveil.llm.textops import sliding_argmin

FOLDER = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, _k string"


def noisy_texts(seed, unit, n):
    rng = random.Random(seed)
    base = [[rng.choice(unit) for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(unit)
        t = t[rng.randint(0, 30) :] + (rng.choice(base)[: rng.randint(0, 60)] if rng.random() < 0.3 else [])
        rows.append((i if i % 11 else None, t))
    return rows


def test_repeated_words(spark):
    rows = [(i, " ".join(t) + " \n", "x") for i, t in noisy_texts(1, [f"w{i}" for i in range(30)] + ["é"], 50)]
    rows += [(200, None, ""), (201, "", ""), (202, "a " * 60, ""), (203, "a " * 40, ""), (7, rows[7][1], ""), (7, "w1 w2 w3 other", "")]
    starts = defaultdict(lambda: 10**9)
    for i, t, _ in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            if i is not None:
                starts[tuple(w[j : j + 13])] = min(starts[tuple(w[j : j + 13])], i)
    want = []
    for i, t, _ in rows:
        w, gone = (t or "").split(), set()
        for j in range(len(w) - 12):
            if i is not None and starts[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_levels.remove_repeated_windows(spark.createDataFrame(rows, TEXT)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == sorted(want, key=str)
    assert substring_levels.remove_repeated_windows(spark.createDataFrame([], TEXT)).count() == 0


def test_repeated_bytes(spark):
    rows = [(i, "".join(t), "x") for i, t in noisy_texts(2, "abcé ", 40)]
    rows += [(100, None, ""), (101, "", ""), (102, "a" * 300, ""), (103, "ab" * 90, ""), (5, rows[5][1], ""), (104, "\0" * 80 + "q", "")]
    for width, crowded in ((40, 4096), (40, 2)):
        found = Counter((t or "").encode()[j : j + width] for _, t, _ in rows for j in range(len((t or "").encode()) - width + 1))
        want = []
        for i, t, _ in rows:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for j in range(len(b) - width + 1):
                gone[j : j + width] |= found[b[j : j + width]] > 1
            runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
            want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        got = suffix_parsing.remove_repeated_bytes(spark.createDataFrame(rows, TEXT), width, crowded).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == sorted(want, key=str)


def test_sliding_argmin():
    x = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 64):
        assert sliding_argmin(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(200 - w + 1)]


def fingerprint(text):
    w = bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints_and_classes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(900, None), (901, " \n"), (902, "one"), (903, "One")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r._print % 2**64, r.component_id) for r in simhash_trees.near_duplicate_classes(docs).collect()}
    assert got == {i: (prints[i], root(i)) for i in ids}


def test_both_trees_find_all_pairs(spark):
    rng = random.Random(4)
    points = {rng.getrandbits(64) for _ in range(60)}
    for p in list(points):
        points |= {p ^ 1 << rng.randrange(64), p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    signed = sorted(p - 2**64 if p >> 63 else p for p in points)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2}
    frame = spark.createDataFrame([(p,) for p in signed], "_print long")
    for crowded in (4096, 0):
        links = [tuple(sorted((r.a, r.b))) for r in simhash_trees.near_links(frame, 2, crowded).collect()]
        assert set(links) == want


def test_near_dedup_finds_candidates_by_the_trees(spark, monkeypatch):
    """What the trees find needs no band in common; what they find is verified all the same."""
    bands = shingle_sets.with_bands
    monkeypatch.setattr(shingle_sets, "with_bands", lambda *a: bands(*a).withColumn("_keys", F.array().cast("array<long>")))
    words = [f"w{i}" for i in range(900)]
    rows = [(3, " ".join(words)), (1, " ".join([*words, "end"])), (2, " ".join(words[:450])), (4, "some other text of a few words"), (5, None), (6, "")]
    rows += [(7, " ".join([*words[:40], *words])), (8, " ".join(words).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r._print for r in simhash_trees.with_fingerprint(df, ["doc_id"], 5).collect()}
    assert bin((prints[1] ^ prints[3]) & (2**64 - 1)).count("1") <= 2 < bin((prints[2] ^ prints[3]) & (2**64 - 1)).count("1")
    assert sorted(r.doc_id for r in simhash_trees.keep_one_each(df).collect() if r.doc_id != 7) == [1, 2, 4, 5]


def test_nodes_share_a_key_if_their_fingerprints_are_near(spark):
    prints = [0, 1, 3, 7, 7, -1, 2**40]
    nodes = spark.createDataFrame(list(enumerate(prints)), "_print long, _finger long")
    by_key = defaultdict(set)
    for r in simhash_trees.tree_keys(nodes).collect():
        by_key[r.key].add(r._print)
    met = {(a, b) for g in by_key.values() for a in g for b in g if a < b}
    assert met == {(a, b) for a in range(7) for b in range(a + 1, 7) if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2}


def test_one_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(3, text, "a"), (1, text, "b"), (1, text, "b"), (None, text, ""), (4, "other words here", ""), (5, None, ""), (6, "", "")], TEXT)
    kept = simhash_trees.keep_one_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5] and kept.columns == df.columns


def test_near_copies_at_all_similarities(spark):
    rng = random.Random(8)
    rows, groups = [], 60
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 260))]
        rows.append((2 * g, " ".join(base)))
        for p in rng.sample(range(len(base)), rng.randint(1, 5)):
            base[p] = "changed"
        rows.append((2 * g + 1, " \n".join(base).title()))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    alike = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(groups)]
    want = {2 * g for g in range(groups)} | {2 * g + 1 for g in range(groups) if alike[g] < 0.8}
    assert sum(0.8 <= x < 0.97 for x in alike) > 30 and len(want) > groups
    kept = {r.doc_id for r in simhash_trees.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= kept and len(kept - want) <= 1


def test_chain_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(24):  # neighbours are similar, the ends have next to nothing in common
        words[i * 8 : i * 8 + 4] = [f"new{i}x{j}" for j in range(4)]
        chain.append((i, " ".join(words), "x"))
    kept = simhash_trees.keep_one_each(spark.createDataFrame(chain, TEXT))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(0, 40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(links.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def classes_of(n, linked):
    """Smallest number that links reach, for those of n numbers that have a link."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        x, y = sorted((root(i), root(j)))
        parent[y] = x
    size = Counter(root(i) for i in range(n))
    return {i: root(i) for i in range(n) if size[root(i)] > 1}


def near(a, b, tau=2, per_edit=10):
    return abs(len(a) - len(b)) <= tau and edit_distance(a, b) <= min(tau, min(len(a), len(b)) // per_edit)


def edited_lines(seed, n, shortest=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé fg") for _ in range(rng.randint(shortest, 60))) for _ in range(8)]

    def edited(t):
        for _ in range(rng.randint(0, 4)):
            p, kind = rng.randrange(len(t) + 1), rng.randint(0, 2)
            t = t[:p] + ("" if kind == 0 else rng.choice("xyzé")) + t[p + (kind != 1) :]
        return t

    return [edited(rng.choice(base)) for _ in range(n)]


def test_edit_join_by_both_indexes_and_by_pivots(spark):
    lines = sorted(set(edited_lines(3, 260)))
    want = classes_of(len(lines), [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if near(lines[i], lines[j])])
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    for crowded, levels in ((1024, (6, 14)), (16, (6, 14)), (0, (5,))):  # 0: every shared key is crowded
        got = {r.node: r.component for r in line_edit_join.near_classes(frame, 2, 10, crowded, levels).collect()}
        assert got == want and want


def plain_line_dedup(rows):
    """By id: (text without the lines that go, equal ones, near ones)."""
    key = lambda i, t: (i is None, i or 0, t)
    places = [(key(i, t), i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    distinct = sorted({x for *_, x in places})
    component = classes_of(len(distinct), [(i, j) for i in range(len(distinct)) for j in range(i + 1, len(distinct)) if near(distinct[i], distinct[j])])
    number = {x: i for i, x in enumerate(distinct)}
    first, root = {}, {}
    for k, _, n, x in places:
        c = component.get(number[x], number[x])
        first[x] = min(first.get(x, (k, n)), (k, n))
        root[c] = min(root.get(c, (k, n)), (k, n))
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept, equal, close = [], 0, 0
        for n, x in enumerate(t.split("\n")):
            if x in number and (key(i, t), n) != root[component.get(number[x], number[x])]:
                isnear = (key(i, t), n) == first[x]
                close, equal = close + isnear, equal + (not isnear)
            else:
                kept.append(x)
        out[i] = ("\n".join(kept), equal, close)
    return out


def test_lines_that_go(spark, tmp_path):
    one, two = "a long enough line here now ok", "second line is unique to me, yes it is"
    rows = [(1, f"{one}\nshort\n{two}"), (2, f"{one}\nshort\n\n\t\nx"), (3, None), (None, ""), (4, two.replace("q", "x") + "\n"), (5, f"x\n{one}!\n{one}!")]
    rows += [(10 + i, "\n".join(edited_lines(20 + i, 6))) for i in range(12)] + [(40 + i, "\n".join(edited_lines(20, 4 + i))) for i in range(3)]
    want = plain_line_dedup(rows)
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, gone string, n_chars int")
    got = {r.doc_id: r for r in line_edit_join.dedup_lines(df).collect()}
    assert {i: r.text for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(r.n_chars == (len(r.text) if sum(want[i][1:]) else 7) and r.gone == "x" for i, r in got.items())
    df.write.parquet(str(tmp_path / "documents.parquet"))
    counts = {r.doc_id: (r.n_equal, r.n_near) for r in line_edit_join.op6_line_edit_join(spark, str(tmp_path)).collect()}
    assert counts == {i: w[1:] for i, w in want.items()}
    assert line_edit_join.dedup_lines(df.limit(0)).count() == 0


def test_equal_rows_of_one_id_and_of_none(spark):
    """Rows are told apart by id and text, however many share an id or have none."""
    rng = random.Random(9)
    base = [rng.choice("abcd") for _ in range(90)]
    rows = [(None if i % 2 else 7, "".join(base[: rng.randint(30, 90)]) + f"{i}q" * 12) for i in range(1000)]
    rows += rows[:5]
    found = Counter(t.encode()[j : j + 40] for _, t in rows for j in range(len(t) - 39))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 39):
            gone[j : j + 40] |= found[t.encode()[j : j + 40]] > 1
        want.append((str(i), "".join(x for x, g in zip(t, gone, strict=True) if not g)))
    got = suffix_parsing.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 40, 64).collect()
    assert sorted((str(r.doc_id), r.kept.decode()) for r in got) == sorted(want)
    words = [(i, " ".join(t)) for i, t in rows]
    got = substring_levels.remove_repeated_windows(spark.createDataFrame(words, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == sorted((str(i), t) for i, t in words)  # no smaller id
    lines = line_edit_join.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(lines) == len(rows)


def test_contract_width_on_real_text(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = Counter(b[j : j + 400] for _, b in rows for j in range(len(b) - 399))
    got = {r.doc_id: r for r in suffix_parsing.op8_suffix_parsing(spark, FOLDER).collect()}
    removed = 0
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 399):
            if found[b[j : j + 400]] > 1:
                gone[j : j + 400] = True
        removed += bool(gone.any())
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), int(gone.sum()), spans)
        assert got[i].kept_sha256 == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    assert removed


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (301, [1.0, None] * 4), (302, [1.0] * 3), (303, x[7].tolist())]
    got = defaultdict(list)
    for r in collision_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = [*range(300), 303]
    unit = np.vstack([x, x[7]])
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    assert set(got) == set(range(0, 300, 50))
    for q, found in got.items():  # all of them, in order, with exact scores
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((ids, -np.round(score, 12)))[:5]
        assert [ids[i] for i in best] == [v for v, _ in found] and np.allclose(score[best], [x for _, x in found], atol=1e-12)
    assert [v for v, _ in got[0]] and collision_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_leave_all_neighbours(spark):
    x = np.random.default_rng(6).normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    find = lambda r: [tuple(y) for y in collision_search.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0).orderBy("rank").collect()]
    once = find(rows)
    assert len(once) == 5 and find(rows + rows) == once


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    extra = ["it's don't 'tis 's 'sabc I'LL x'  'd \n's", "a  b\n\nc \t d   ", " ", "", None, "naïve ½ x² 12 345'm!!'s ...\r\n　\xa0é", "<|endoftext|> x", " a<|endoftext|><|endoftext|>  b <|endoftext| >", "<|endof", "text|>", "日本語🙂🙂 ok", "word" * 5000]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(extra)], "doc_id long, text string"))
    rows = packing.pack(docs).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        pieces = rows[rows.doc_id == r.doc_id].sort_values("start")
        assert [i for p in pieces.ids for i in p] == want and set(pieces.doc_tokens) == {len(want)}
        assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length for p in pieces.itertuples())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]


def test_cuts_are_the_cheapest():
    rng = random.Random(6)
    for _ in range(30):
        places = np.cumsum([0] + [rng.randint(1, 9) for _ in range(14)])
        price = np.array([rng.choice([0.0, 2.0, 7.0]) for _ in places])
        cuts = packing.best_cuts(places, price, 12).tolist()
        best = {0: 0.0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + 12 - (places[j] - places[i]) + price[j] for i in range(j) if places[j] - places[i] <= 12)
        at = {int(p): j for j, p in enumerate(places)}
        cost = sum(12 - (b - a) + price[at[b]] for a, b in zip([0, *cuts], cuts, strict=False))
        assert abs(cost - best[len(places) - 1]) < 1e-9


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def poisson(u, rate):
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_pipeline_against_plain_python(spark, tmp_path):
    """Five stages over texts with planted copies: rules, lines, near copies at 0.8 and more, copies drawn, and tokens packed."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    docs = []
    for i in range(70):
        w = [rng.choice(words) for _ in range(rng.randint(60, 140))]
        docs.append([" ".join(w[j : j + 12]) for j in range(0, len(w), 12)])
    for g in range(10):  # near copies: a few words of a text written without line breaks
        w = [rng.choice(words) for _ in range(150)]
        docs.append([" ".join(w)])
        for p in rng.sample(range(150), g % 5):
            w[p] = "changed"
        docs.append([" ".join(w)])
    docs += [docs[0], ["few words"], ["same words again and again now"] * 9, docs[3][:2] + ["a line of its own, number one", "a line of its own, number two"]]
    rows = [(i, "\n".join(t), "en", "s" if i % 3 else "t", sum(map(len, t))) for i, t in enumerate(docs)]
    rows.append((None, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    one = stages["quality_rules"](spark, docs, "")
    kept = plain(one)
    repeated = lambda t: Counter(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)).most_common(1)[0][1] > 1
    assert {i for i, _ in kept} == {i for i, t, *_ in rows if t and len(t.split()) >= 10 and not repeated(t)}

    two = stages["line_dedup"](spark, one, "")
    assert sorted(plain(two)) == sorted((i, w[0]) for i, w in plain_line_dedup(kept).items())

    three = stages["near_dedup"](spark, two, "")
    left = sorted(plain(two))
    sets = [shingles(t) for _, t in left]
    alike = lambda a, b: a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8
    groups = classes_of(len(left), [(a, b) for a in range(len(left)) for b in range(a + 1, len(left)) if alike(sets[a], sets[b])])
    assert sorted(plain(three)) == [x for n, x in enumerate(left) if groups.get(n, n) == n] and groups

    four = stages["mixing"](spark, three, "")
    sources = Counter(r.source for r in three.collect())
    weights = {s: math.sqrt(n) for s, n in sources.items()}
    want = Counter()
    for r in three.collect():
        u = int(hashlib.md5(f"{r.doc_id}|17|1".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id] = poisson(u, weights[r.source] / sum(weights.values()) * three.count() / sources[r.source])
    assert Counter(i for i, _ in plain(four)) == +want and four.columns == docs.columns

    mixed = four.persist()
    packed = stages["packing"](spark, mixed, "").toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(plain(mixed))
    for i, t in texts.items():
        own = packed[packed.doc_id == i].sort_values("start", kind="stable")
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert own.length.sum() == len(ids) * want[i] and set(own.doc_tokens) == {len(ids)}
        for p in own.itertuples():
            assert list(p.ids) == ids[p.start : p.start + p.length]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_on_odd_tables(spark):
    """Null fields, empty and repeated rows, no row: every stage gives a table with the same columns."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, k long, _rate double"
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", 1, 1.0), (1, "", "en", "s", 0, "x", 1, 1.0), (None, " ".join(f"w{i}" for i in range(30000)), None, None, 5, "y", 2, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, "")
            assert name == "packing" or out.columns == odd.columns
            assert len(out.collect()) >= 0


def test_line_dedup_and_components_send_no_table_to_all(spark):
    """What grows with the input is never built as one table in the driver, however small the planner takes it to be."""
    near = [(1, "the quick brown fox jumps over the lazy dog\nshort"), (2, "the quick brown fox jumped over the lazy dog\nother"), (3, "the quick brown fox jumps over the lazy dog")]
    docs = spark.createDataFrame([*near, *((i, f"a line of its own number {i * 7919} {i}") for i in range(4, 60))], "doc_id long, text string")
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsCount()
    got = {r.doc_id: r.text for r in line_edit_join.dedup_lines(docs).collect()}
    assert got[1] == near[0][1] and got[2] == "other" and got[3] == "" and len(got) == len(near) + 56
    plans = [executions.executionsList(i, 1).apply(0).physicalPlanDescription() for i in range(before, executions.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)


def test_near_dedup_sends_no_table_to_all(spark):
    """Exploded keys, visits and pairs are many times what the planner takes them to be."""
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), *((i, " ".join(f"x{i * 97 + j}" for j in range(30))) for i in range(3, 60))], "doc_id long, text string")
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsCount()
    assert sorted(r.doc_id for r in simhash_trees.keep_one_each(docs).collect()) == [1, *range(3, 60)]
    assert simhash_trees.near_duplicate_classes(docs).count() == 59
    plans = [executions.executionsList(i, 1).apply(0).physicalPlanDescription() for i in range(before, executions.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_passages_that_are_too_short_in_bytes_are_counted_by_words(spark):
    """A passage of 51 short words, far under 400 bytes, shows in every document that has it, and in no other; so does a repeat in one document."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    text = lambda n: [word() for _ in range(n)]
    passage, shorter = text(51), text(49)
    rows = [(i, " ".join(text(60) + (passage if i % 3 == 0 else shorter) + text(60))) for i in range(30)]
    rows += [(100, "\n".join(passage)), (101, " ".join(passage[:49])), (102, " ".join(text(60) * 2)), (None, "x " + "  ".join(passage)), (103, None), (104, "")]
    got = {r.doc_id: r for r in suffix_parsing.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_shared_windows for i, r in got.items()} == {i: 2 if i in (None, 100) or i < 30 and i % 3 == 0 else 0 for i, _ in rows}
    assert all(r.n_removed == 0 for i, r in got.items() if i != 102)
