"""Spelling variants, conversation repair and the set join against plain Python and DuckDB."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pandas as pd
import pytest

from sparkveil.llm import heavy_light_join, spelling_variants, turn_repair, wordsets
from sparkveil.llm.textops import chunks

DOCS = "doc_id long, text string, lang string, name string, size long, token long, key long, place long, component long, word string, n long"
TURNS = "conv_id long, turn long, role string, text string, seq long, at long, edit string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3, 4, 5, "w", 6) for i, t in rows], DOCS)


def by_sql(sql, **tables):
    with duckdb.connect() as c:
        for name, frame in tables.items():
            c.register(name, frame)
        return c.sql(sql).fetchall()


# ---- conversation repair -------------------------------------------------------------------------------------------


def plain_repair(rows):
    """The cheapest (cost, audit) of each state, row by row. ``rows``: (turn, role, text), not in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, marks = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] = counts.get(fault, 0) + 1
        marks.append((role, text, fault))
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    full = {"u": "user", "a": "assistant"}

    def widened(states):
        for _ in range(4):
            for (state, lines), (cost, audit) in list(states.items()):
                for want in "ua":
                    if (state, want) in moves:
                        key, value = (moves[state, want], (*lines, full[want] + ":")), (cost + 2, audit + "I")
                        if len(key[1]) <= len(marks) + 4 and (key not in states or value < states[key]):
                            states[key] = value
        return states

    def best(states):
        out = {}
        for (state, lines), value in states.items():
            if state not in out or value < out[state][0]:
                out[state] = (value, lines)
        return {(state, lines): value for state, (value, lines) in out.items()}

    states = {(0, ()): (0, "")}
    for role, text, fault in marks:
        after = {}

        def offer(key, value, after=after):
            if key not in after or value < after[key]:
                after[key] = value

        for key, (cost, audit) in states.items():
            offer(key, (cost + 3, audit + "D"))
        if fault not in ("blank", "duplicate"):
            for (state, lines), (cost, audit) in widened(dict(states)).items():
                for want in "sua":
                    if (state, want) in moves and (want == role[:1] or want in full):
                        kept = want == role[:1]
                        line = (role if kept else full[want]) + ":" + text
                        offer((moves[state, want], (*lines, line)), (cost + (not kept) * 2 + (fault == "truncated"), audit + ("K" if kept else "R")))
        states = best(after)
    (cost, audit), lines = min((value, lines) for (state, lines), value in widened(states).items() if state in (0, 3))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
            yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(r.randrange(9)):
            turn = r.choice([None, 0, 1, 2, 3, 4, 5, 6, 9])
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "su"]), r.choice(["Yes.", "No!", "why", "", " \t", None, "A. b", "Ça va?\n"])))
    return rows + rows[::7]


@pytest.fixture
def as_query(spark, tmp_path):
    def run(query, name, frame):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
        return query(spark, str(tmp_path))

    return run


@pytest.mark.parametrize("bits", [12, 1])
def test_turns_are_repaired_at_least_cost(spark, as_query, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "_BLOCK_BITS", bits)  # 1: a segment has two rows at most
    rows = conversations(3, 40)
    got = as_query(turn_repair.op12_turn_repair, "conversations", spark.createDataFrame([(*x, 1, 2, "z") for x in rows], TURNS)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    want, of = {}, {}
    for conv, *row in damaged(rows):
        of.setdefault(conv, []).append(tuple(row))
    for conv in {x[0] for x in rows}:
        want[conv] = plain_repair(of.get(conv, []))
    assert {r["conv_id"]: tuple(r[k] for k in names) for r in got} == want
    assert len(got) == len(want)


def test_turn_sql_agrees(spark, as_query):
    rows = [(c, t, r or "x", x) for c, t, r, x in conversations(8, 30) if c is not None]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    got = as_query(turn_repair.op12_turn_repair, "conversations", spark.createDataFrame([(*x, 1, 2, "z") for x in rows], TURNS))
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert sorted(map(tuple, got.selectExpr(*names.split(", ")).collect())) == sorted(by_sql(f"SELECT {names} FROM ({turn_repair.OP12_SQL})", conversations=frame))


def test_a_long_conversation_and_an_empty_table(spark):
    none = turn_repair.Repair(spark.createDataFrame([], TURNS))
    assert none.turns().count() == none.audits().count() == none.faults().count() == none.digests().count() == 0
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}. " + "x" * (200_000 if i == 5 else 0) + ".") for i in range(9000)]
    one = turn_repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert one.audits().first()["audit"] == "K" * 9000
    assert one.courses.first()["cost"] == 0
    assert one.digests().first()["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()
    assert one.turns().where("edit <> 'K'").count() == 0


def test_many_equal_rows_are_one_kept_turn(spark):
    rows = [(1, 1, "user", "Hello.")] * 5000 + [(1, 2, "assistant", "Yes.")]
    one = turn_repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert one.audits().first()["audit"] == "K" + "D" * 4999 + "K"
    assert one.faults().first()["duplicate"] == 4999


# ---- spelling variants ---------------------------------------------------------------------------------------------


def plain_variants(rows):
    counts = {}
    alphabet = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}
    for doc, text in rows:
        for inside, run in itertools.groupby(text or "", alphabet.__contains__):
            if inside:
                word = "".join(c.lower() if c < "\x80" else c for c in run)
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                word = word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word
                counts[word] = counts.get(word, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: sorted((-words[x], x) for x in words if near(w, x)) for w in words}
    form = {w: c[0][1] if c and -c[0][0] >= 2 * words[w] else None for w, c in close.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(close[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def prose(seed, docs, words):
    r = random.Random(seed)
    bases = ["letter", "lettre", "Ébauche", "straße", "aabbaa", "window", "widow", "wwindow", "colour", "color", "ça", "x" * 70, "x" * 69 + "y", "y" + "x" * 70, "x" * 64, "x" * 65, "x" * 63]
    weights = [len(bases) - i if len(b) < 60 else 4 for i, b in enumerate(bases)]

    def word():
        w = r.choices(bases, weights)[0]
        if r.random() < 0.3 and len(w) < 60:
            i = r.randrange(len(w))
            w = r.choice([w[:i] + r.choice("abcé") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + r.choice("abcé") + w[i:], w.upper()])
        return w

    return [(r.choice([None, *range(500)]), "".join(word() + r.choice([" ", "-", "1", "ā", "\n", "’"]) for _ in range(words))) for _ in range(docs)]


def test_variants_against_plain_python(spark, as_query):
    rows = [*prose(5, 120, 60), (7, None), (8, ""), (9, "12 34"), (9, "12 34")]
    got = as_query(spelling_variants.op11_spelling_variants, "documents", documents(spark, rows)).collect()
    want = plain_variants(rows)
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want
    assert len(got) == len(want) > 100
    assert any(len(w) > spelling_variants.LONG and v[1] for w, v in want.items())


def test_variant_sql_agrees(spark, as_query):
    rows = [(i, t) for i, t in prose(6, 60, 50) if i is not None]
    names = "word, n, n_near, form, form_n, root"
    got = as_query(spelling_variants.op11_spelling_variants, "documents", documents(spark, rows)).selectExpr(*names.split(", "))
    want = by_sql(f"SELECT {names} FROM ({spelling_variants.OP11_SQL})", documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_variants_of_huge_words_and_nothing(spark):
    assert spelling_variants.group_variants(documents(spark, [])).count() == 0
    long = "ab" * 5_000
    rows = [(i, w) for i, w in enumerate([long] * 8 + [long + "c"] * 3 + [long[:-1]] * 3)]
    got = {r["word"]: r for r in spelling_variants.group_variants(documents(spark, rows), modulus=1 << 30).collect()}
    assert {w: (r["n"], r["n_near"], r["form"]) for w, r in got.items()} == {long: (8, 2, None), long + "c": (3, 1, long), long[:-1]: (3, 1, long)}


# ---- set join ------------------------------------------------------------------------------------------------------


def plain_sets(rows, shingle=4, percent=85):
    sets = []
    for _, text in rows:
        words = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").translate(dict.fromkeys([32, *range(9, 14)], " ")).split(" ") if w]
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i] and sets[j]:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def copies(seed, groups):
    r = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for _ in range(groups):
        base = [r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(r.choice([1, 2, 3, 5, 9, 12, 14, 16, 20, 25, 30, 60, 150]))]
        base += passage if r.random() < 0.3 else []
        for _ in range(r.choice([1, 1, 2, 3, 6])):
            words = list(base)
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"new{r.randrange(9)}"
            rows.append((r.choice([None, *range(10_000)]), r.choice([" ", "\n", "  "]).join(words)))
    return [*rows, (1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "ONE TWO"), (6, "one  two"), *rows[:5]]


@pytest.mark.parametrize("seed", [1])
def test_join_against_all_pairs(spark, as_query, seed):
    rows = copies(seed, 150)
    got = as_query(heavy_light_join.op13_heavy_light_join, "documents", documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_sets(rows)


def test_join_of_sets_near_one_hub(spark):
    """Copies of one text that change in some of the same places: many are similar to each other, but not to the most central one."""
    r, rows = random.Random(9), []
    base = [f"w{i}" for i in range(90)]
    for i in range(120):
        words = list(base)
        for at in r.sample(range(5, 85, 8), r.randrange(8)):
            words[at] = r.choice(["new", "other"])
        rows.append((i, " ".join(words)))
    want = plain_sets(rows)
    assert 3 < len({c for *_, c in want}) < 100
    got = heavy_light_join.linked_sets(documents(spark, rows)).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == want


def test_sets_near_one_hub_meet_only_if_they_can_share_enough(spark, monkeypatch):
    """Copies with two words of their own lack some of the same shingles, pair by pair, and are not similar for that."""
    r, rows, met = random.Random(5), [], []
    for i in range(150):
        words = [f"w{j}" for j in range(64)]
        for at in r.sample(range(5, 60), 2 if i else 0):
            words[at] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[7][1] + " end"), (201, rows[9][1] + " end")]
    keep = heavy_light_join.stored
    monkeypatch.setattr(heavy_light_join, "stored", lambda df, name: (out := keep(df, name), met.append(out.count()) if name == "met" else None)[0])
    got = heavy_light_join.linked_sets(documents(spark, rows)).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == plain_sets(rows)
    assert len(met) == 1 and met[0] <= 2 * len(rows)


@pytest.mark.parametrize("boundary", [8])
def test_join_is_whole_wherever_the_boundary_lies(spark, monkeypatch, boundary):
    monkeypatch.setattr(heavy_light_join, "choose_boundary", lambda *a: boundary)
    rows = copies(3, 80)
    got = heavy_light_join.linked_sets(documents(spark, rows), 3, 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_sets(rows, 3, 80)


def test_join_of_nothing_and_sql(spark, as_query):
    assert heavy_light_join.linked_sets(documents(spark, [])).count() == 0
    rows = [(i, t) for i, (_, t) in enumerate(copies(4, 60))]
    got = as_query(heavy_light_join.op13_heavy_light_join, "documents", documents(spark, rows)).select("doc_id", "n_shingles", "component_id")
    want = by_sql(f"SELECT doc_id, n_shingles, component_id FROM ({heavy_light_join.OP13_SQL})", documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_boundary_follows_cost():
    assert heavy_light_join.choose_boundary({}, {}, 85) == 0
    assert heavy_light_join.choose_boundary({10: 1000}, {10: 0}, 85) == 0  # lists without partners cost least
    assert heavy_light_join.choose_boundary({10: 1000}, {10: 10**6}, 85) >= 10


def test_word_values_tell_constructed_words_apart():
    import pyarrow as pa

    word = other = "a"
    other = "b"
    for _ in range(11):  # words that polynomials modulo powers of two cannot tell apart
        word, other = word + other, other + word
    texts = pa.array([word.encode(), other.encode(), b"a", b"a\0", b"aaaaaaaa", b"aaaaaaaab", word[:300].encode(), other[:300].encode()], pa.large_binary())
    found = []
    for c in chunks(texts):
        c.words()
        found += wordsets.word_values(c).tolist()
    assert len(set(found)) == len(texts)
