"""Every dealt operator against a brute-force version, and its edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from check import TABLES, rows_by_name
from twinledger.llm import chat, decontaminate, lines, mixing, pii, tokens, toxicity, urls, vectors
from twinledger.llm.common import components, pick
from twinledger.llm.minhash import NearDuplicates, near_duplicates
from twinledger.llm.queries import LLM_ORACLES, LLM_QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))

EDGES = [
    (None, "a text without an id", "en", "s", 20),
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", None, 4),
    (4, LONG, "en", "s", len(LONG)),
    (5, LONG, "en", "t", len(LONG)),
    (6, "same words here\nand a second line of it", "en", "s", 38),
    (6, "same words here\nand a second line of it", "en", "s", 38),
    (7, "same words here\nand a second line of it", "en", "u", 38),
    (8, "one", "en", "u", 3),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def edges(spark):
    """The edge rows with extra columns whose names clash with results and with ``text``."""
    df = frame(spark, EDGES)
    for name in ("TEXT", "id", "row", "kept", "score", "component_id", "n_cut", "source_1", "block"):
        df = df.select("*", df["n_chars"].alias(name))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = LLM_QUERIES[name](spark, SMALL)
    cursor = db.execute(LLM_ORACLES[name])
    want = rows_by_name([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_by_name(df.columns, df.collect()) == want


def union_find(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(600, 700)] + [(9, 9)]
    want = union_find(links, {n for link in links for n in link})
    got = {r.id: r.component_id for r in components(frame(spark, links, "a long, b long"), "test").collect()}
    assert got == {n: c for n, c in want.items() if n in got}
    assert all(c == n for n, c in want.items() if n not in got)


def test_pick_prefers_the_exact_name(spark):
    df = spark.createDataFrame([(1, "no", "yes")], "doc_id long, TEXT string, text string")
    assert pick(df, "doc_id", body="text").first() == (1, "yes")


# 1: vectors


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows, vec = [], 0
    for centre in base:
        for _ in range(rng.integers(1, 9)):
            v = centre + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.25])
            rows.append((vec, v.tolist(), int(vec % 3) if vec % 17 else None))
            vec += 1
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, None, 0), (903, [0.0] * 16, 0),
             (904, [float("nan")] * 16, 0), (905, [None] + [1.0] * 15, 0), (906, [1.0, 2.0], 0),
             (907, [2.0, 4.0], 0), (None, rows[0][1], 0), (901, rows[0][1], 0)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int")
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = (label, np.array(v))
    links = [
        (a, b) for a in good for b in good if a < b and good[a][0] == good[b][0]
        and len(good[a][1]) == len(good[b][1])
        and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.98
    ]
    comp = union_find(links, {i for i, *_ in rows if i is not None})
    degree = collections.Counter(x for link in links for x in link)
    got = vectors.vector_links(df, vectors.VectorLinks(block=4)).collect()
    assert len(got) == len(rows) and len(links) > 30
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)


def test_vector_links_of_nothing(spark):
    assert vectors.vector_links(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


def test_windows_cross_partition_borders():
    keys = np.arange(10, dtype=np.int64) % 2
    rows = {"id": np.arange(10), "grp": np.zeros(10), "pass": np.zeros(10), "key": keys}
    found = {(a, b) for x, y in vectors.window_pairs(rows, 3, 64, 4) for a, b in zip(x, y)}
    assert found == {(a, b) for a in range(10) for b in range(max(4, a + 1), min(10, a + 4))}


# 2: urls


def test_url_rules_and_verdicts(spark):
    rows = [
        (1, "https://A.Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://notexample.org/en/12"),
        (4, "x.com/fr/"), (5, None), (6, ""), (7, "ftp://u.com/fr/a://b"), (8, "http://q.com?/fr/"),
        (9, "http://net"), (10, "http://h.com/de/" + "a" * 50_000), (10, "http://h.com/de/z"), (None, "http://a.org/"),
    ]
    got = {(r.page_id, r.host[:20], r.path[:8]): (r.rule, r.verdict) for r in urls.url_verdicts(
        spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "url AS URL_", "page_id AS rule")).collect()}
    assert got[(1, "a.example.org", "/es/1")] == ("example.org/es/", "block")
    assert got[(2, "example.org", "/en/12")] == ("example.org/en/1", "block")
    assert got[(3, "notexample.org", "/en/12")] == ("org/", "allow")
    assert got[(7, "u.com", "/fr/a://")] == ("com/fr/", "allow")
    assert got[(8, "q.com", "")][0] is None and got[(4, "", "")][0] is None
    assert len(got) == 12 and {v for _, v in got.values()} == {"allow", "block"}
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_holds_on_unseen_urls(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    made = [(f"http://{word()}.net/{'casino' if bad else 'science'}/{word()}", bad) for bad in [0, 1] * 300]
    labelled = spark.createDataFrame(made[:400], "url string, blocked int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made[400:])], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in urls.url_verdicts(pages, {}, labelled).collect()}
    assert np.mean([got[i] == bool(bad) for i, (_, bad) in enumerate(made[400:])]) > 0.97


# 3: line chunks


def brute_lines(rows):
    spec, seen, out = lines.LineChunks(), {}, {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        body, chunks = lines.chunk_lines(text, spec)
        kept = []
        for number, (first, last, removable) in enumerate(chunks):
            piece = "\n".join(body[first:last])
            if not removable or seen.setdefault(piece, (doc, number)) == (doc, number):
                kept += body[first:last]
        out[doc] = "\n".join(kept)
    return out


def test_line_chunks_equal_brute_force(spark, edges):
    rng = random.Random(2)
    passage = [f"shared line {i} of a passage" for i in range(12)]
    rows = []
    for doc in range(60):
        own = [f"line {doc} {rng.random()}" for _ in range(rng.randrange(1, 15))]
        at = rng.randrange(len(own) + 1)
        rows.append((doc, "\n".join(own[:at] + (passage if doc % 3 else []) + own[at:]), "en", "s", 0))
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert {d: r.text for d, r in got.items()} == brute_lines([r[:2] for r in rows])
    assert sum(r.n_cut > 0 for r in got.values()) > 30
    got = lines.dedup_lines(edges).collect()
    want = brute_lines([r[:2] for r in EDGES])
    assert len(got) == len(EDGES)
    for r in got:
        assert r.text == (want[r.doc_id] if r.doc_id in want else {None: EDGES[0][1], 1: None}[r.doc_id])
    assert len(got[0]) == len(edges.columns)
    assert want[5] == LONG or want[5] == ""


def test_no_long_run_of_earlier_lines_is_left(spark):
    """Passages of one to eight lines; brute force over lines, without chunks or windows."""
    rng = random.Random(12)
    phrase = lambda tag, n: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    passages = [[phrase(f"p{i}x", rng.randrange(8, 49)) for _ in range(rng.randrange(1, 9))] for i in range(40)]
    texts = {}
    for doc in range(120):
        body = []
        for _ in range(rng.randrange(1, 4)):
            body += [phrase("own", rng.randrange(1, 30)) for _ in range(rng.randrange(4))]
            body += [x for x in rng.choice(passages) if x not in body]
        texts[doc] = body
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, [(d, "\n".join(b), "en", "s", 0) for d, b in texts.items()])).collect()}
    runs = 0
    for doc, body in texts.items():
        left = set(got[doc].text.split("\n"))
        assert [x for x in body if x in left] == [x for x in got[doc].text.split("\n") if x]
        earlier = {x for before in range(doc) for x in texts[before]}
        assert all(x in left or x in earlier for x in body)
        assert (got[doc].n_cut > 0) == (len(left & set(body)) < len(body))
        for before in range(doc):
            other = texts[before]
            for a in range(len(body)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(body) and b + n < len(other) and body[a + n] == other[b + n]:
                        n += 1
                    words = kept = most = 0
                    for x in body[a : a + n]:
                        words += len(x.split())
                        kept = kept + len(x.split()) if x in left else 0
                        most = max(most, kept)
                    runs += words > 50
                    assert most < 50, (doc, before, body[a : a + n])
    assert runs > 100


def test_windows_cover_runs_of_lines():
    rng = random.Random(13)
    for _ in range(200):
        body = [" ".join(["w"] * rng.choice([0, 3, 20, 40])) + f" {i}" * (rng.random() < 0.8) for i in range(rng.randrange(1, 30))]
        first, end, *_ = lines.line_windows(body)
        at, to = sorted(rng.sample(range(len(body) + 1), 2))
        solid = {i for i in range(at, to) if body[i].strip()}
        inside = {i for f, e in zip(first, end) if at <= f and e <= to for i in range(f, e)}
        enough = sum(len(x.split()) for x in body[at:to]) >= 50
        assert solid <= inside if enough else not inside


def test_line_chunks_of_nothing(empty):
    assert lines.dedup_lines(empty).count() == 0


def test_chunk_borders_resist_shifts():
    body = [f"line {i * 7919 % 1000}" for i in range(40)]
    spans = {tuple(body[a:b]) for a, b, _ in lines.chunk_lines("\n".join(body))[1]}
    text, chunks = lines.chunk_lines("\n".join(["new first line", *body, "last"]))
    shifted = {tuple(text[a:b]) for a, b, _ in chunks}
    assert len(spans & shifted) >= len(spans) - 3
    assert all(b - a >= 2 for a, b, _ in chunks)


# 4: decontamination


def brute_hits(text, items):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    hit, found = set(), set()
    for item, body in items:
        asked = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").encode().lower())
        width = min(10, len(asked))
        for s in range(len(asked) - width + 1 if width else 0):
            for p in range(len(words) - width + 1):
                if words[p : p + width] == asked[s : s + width]:
                    hit.update(range(p, p + width))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark, edges):
    items = [(1, "the the the the the the the the the the the"), (2, "Short Answer"), (3, None), (4, "!?"), (10, LONG[:400]),
             (None, "one"), (5, "A b, C d. e-f g h i J k l m"), (5, "A b, C d. e-f g h i J k l m")]
    texts = ["the " * 14, "a short answer, twice: SHORT answer", "x a b c d e f g h i j k l y", "a b c d e f g h i", "é short-answer é", "k l m a b c d e f g h i j k"]
    rows = EDGES + [(20 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], *brute_hits(r[1], [i for i in items if i[0] is not None])) for r in rows), key=str)
    docs = frame(spark, rows).selectExpr("*", "n_chars AS n_hit", "n_chars AS TEXT")
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(edges, none).collect())


def test_decontamination_in_item_blocks(spark, monkeypatch, empty):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 30)
    items = [(i, f"alpha{i} beta{i} gamma{i}") for i in range(6)]
    rows = [(i, f"x alpha{i} beta{i} gamma{i} y beta{i + 1} alpha{i + 1} gamma{i + 1}", "en", "s", 0) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.n_near) for r in got) == [(i, 3, 1, int(i < 5)) for i in range(6)]
    assert decontaminate.contamination(empty, bench).count() == 0


# 5: token trees


@pytest.fixture(scope="module")
def counter():
    with open(tokens.VOCABULARY, "rb") as file:
        return tokens.Counter(file.read())


def test_edited_trees_equal_fresh_counts(counter):
    rng = random.Random(3)
    pieces = ["word", " ", "  ", "\n", "\n\n", "'s", "don't", "12345", "é", "ñandú", "...", "\t", "x", "🙂", " a"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 900)))
        tree = tokens.Tree.build(text, counter)
        assert tree.tokens == len(counter.encode(text))
        for _ in range(12):
            start = rng.randrange(-2, len(text) + 3)
            insert = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 400])))
            before = text
            text, _ = tree.edit(text, start, start + rng.choice([0, 0, 1, 5, 80]), insert, counter)
            assert tree.tokens == len(counter.encode(text)), (before, text)
            assert tree.sums[0, 1] == len(text)
            assert (tree.sums[:, 1] == tree.sums[:, tree.width :].sum(axis=1)).all()


def test_an_edit_reads_little(counter):
    text = "some plain words of a long text. " * 5_000
    tree = tokens.Tree.build(text, counter)
    _, read = tree.edit(text, 80_000, 80_010, "new", counter)
    assert read < 2_000


def test_token_counts_of_edges(spark, edges, empty, counter):
    vocabulary = tokens.read_vocabulary(spark)
    assert tokens.count_tokens(empty, vocabulary).count() == 0
    rows = tokens.apply_edits(tokens.count_tokens(tokens.hashed_edits(edges), vocabulary), vocabulary).collect()
    plain = sorted((r[0] or -1, len(counter.encode(r[1] or ""))) for r in EDGES)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == plain
    assert all(r.n_tokens_edited == len(counter.encode(r.text)) for r in rows)


# 6: near copies


def brute_near(rows, k, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    links = [
        (a, b) for a in sets for b in sets
        if a is not None and b is not None and a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, links, union_find(links, {d for d in sets if d is not None})


@pytest.mark.parametrize("spec", [NearDuplicates(words=3, percent=85), NearDuplicates()])
def test_near_copies_equal_brute_force(spark, spec):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, doc = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(2, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((doc, " ".join(copy).upper() if doc % 5 else "\n".join(copy), "en", "s", 0))
            doc += 1
    sets, links, comp = brute_near([r[:2] for r in rows], spec.words, spec.percent)
    got = near_duplicates(frame(spark, rows), spec).collect()
    assert len(links) > 30 and len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_near_copies_of_edges(edges, empty):
    got = near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert [by[i].n_shingles for i in (1, 2, 3, 8)] == [0, 0, 0, 1]
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 6, 8]
    assert near_duplicates(empty).count() == 0


# 7: chat


def test_template_round_trip():
    rng = random.Random(6)
    marks = ["### ", "</turn>\n", "\\", "\\#", ": ", "a", "\n", "<", "é", "### assistant: "]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a:b", ""]), "".join(rng.choice(marks) for _ in range(rng.randrange(9)))) for _ in range(4)]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[s["start"] : s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse_turns("### user: no end")


def test_best_paths_of_reply_trees(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(12):
        for msg in range(rng.randrange(1, 30)):
            rows.append((conv, msg, rng.randrange(msg) if msg and rng.random() < 0.9 else None, f"t{msg}", rng.randrange(5) * 1.0))
    rows += [(50, 1, 2, "loop", 1.0), (50, 2, 1, "loop", 1.0), (50, 3, 99, "orphan", None), (None, 1, None, "x", 1.0), (3, None, None, "y", 1.0)]
    parent = {(c, m): p for c, m, p, *_ in rows}
    score = {(c, m): s or 0.0 for c, m, _, _, s in rows}
    want = {}
    for c in {r[0] for r in rows}:
        paths = []
        nodes = {m for cc, m in parent if cc == c and m is not None}
        for leaf in nodes - {parent[c, m] for m in nodes}:
            path, at = [], leaf
            while at is not None and (c, at) in parent and at not in path:
                path.append(at)
                at = parent[c, at]
            if at is None or (c, at) not in parent:
                paths.append((-sum(score[c, m] for m in path), -len(path), leaf, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(paths)[:2], 1):
            want[c, rank] = path
    messages = spark.createDataFrame(
        [(c, m, p, "user", t, s) for c, m, p, t, s in rows], "conv long, msg long, parent long, role string, text string, score double"
    )
    got = collections.defaultdict(dict)
    for r in chat.best_paths(messages, 2).collect():
        got[r.conv, r.rank][r.place] = r.msg
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want
    assert chat.format_conversations(messages).where("conv = 50").first().formatted == "### user: orphan</turn>\n"


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "assistant", None), (1, 1, None, "q"), (1, 2, "assistant", None), (None, None, "user", "x"), (2, 1, "user", LONG)]
    df = frame(spark, rows, kind).selectExpr("*", "turn AS msg", "role AS conv", "turn AS score", "text AS ROLE_")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.reply_chain(df))).collect()}
    assert [got[c].n_turns for c in (1, None, 2)] == [3, 1, 1]
    assert got[1].turns_sha256 == hashlib.sha256(b"\nq\nassistant\n\nassistant\n\n").hexdigest()
    assert chat.read_back(chat.format_conversations(chat.reply_chain(frame(spark, [], kind)))).count() == 0


# 8: personal data

_BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    found = []
    for kind, pattern in enumerate(_BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    bits = ["a", "@", ".", "com", "1", "23", "255", "-", " ", "+", "(", ")", "4532", "0151", "1283", "0366", "é", "_", "%", "\n", "999"]
    for _ in range(3_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert [(s.start, s.kind, s.end) for s in pii.base_spans(text)] == brute_spans(text), text
    for text in ("1.1.1.0000000000000999", "a" * 200_000, "1" * 50_000, "@" * 50_000, "4532015112830366"):
        assert len(pii.base_spans(text)) == (text[0] == "4")


def test_personal_data_of_edges(spark, edges, empty):
    got = pii.personal_data(edges).collect()
    assert len(got) == len(EDGES) and all(r.spans == "" for r in got)
    assert pii.personal_data(empty).count() == 0


def test_method_adds_spans_and_keeps_the_base(spark):
    rows = [(i, f"please call our phone +1 (202) 555-{1000 + i} or mail jo{i}@shop.example.com now", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, f"please call our phone (202) 555-{1000 + i} or mail me@b.example.com now", "en", "s", 0) for i in range(10)]
    rows += [(200 + i, f"order token_{i} id 202-555-{1000 + i}_7 of 999.1.1.1", "en", "s", 0) for i in range(30)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for doc, text, *_ in rows:
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(text))
        assert got[doc].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(got[doc].spans.split(","))
    assert all("phone" in got[100 + i].spans and got[100 + i].n_phone == 0 for i in range(10))
    assert all(got[200 + i].spans == "" for i in range(30))


def test_neighbours_are_seen_in_long_texts():
    """A local number beside an email of another kind, alone and after 300 numbers far away."""
    passage = "mail jo@shop.example.com or 202-555-1234"
    for before in ("", "".join(f"202-555-{1000 + i}" + " filler" * 60 for i in range(300))):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([before + passage])], names=["doc_id", "text"])
        (found,) = next(pii._candidates([batch])).column(1).to_pylist()
        assert [pii.unpattern(x["pattern"])[1][4] for x in found if x["start"] >= len(before)] == [1, 1]
        assert len(found) == (302 if before else 2)
        assert not any(pii.unpattern(x["pattern"])[1][4] for x in found if x["start"] < len(before))


def brute_secrets(text: str) -> set[tuple[int, int]]:
    return {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', text)}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_planted_secrets_are_found_at_every_size(spark, sf):
    """Tokens are added spans, nearly all of them; no added span fails its checks or overlaps a base one."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = found = added = 0
    for row in pii.personal_data(docs).collect():
        text = texts[row.doc_id]
        base = [(s.start, s.end) for s in pii.base_spans(text)]
        spans = [x.split(":") for x in row.spans.split(",") if x]
        spans = [(k, int(s), int(e)) for k, s, e in spans]
        extra = [x for x in spans if x[1:] not in base]
        secrets = brute_secrets(text)
        planted += len(secrets)
        found += len(secrets & {(s, e) for k, s, e in extra if k == "secret"})
        added += len(extra)
        for kind, start, end in extra:
            assert not any(s < end and start < e for s, e in base)
            assert kind != "card" or pii.luhn(re.sub("[^0-9]", "", text[start:end]))
            assert kind != "iban" or pii.valid_iban(text[start:end])
    assert planted >= (10 if sf == "0.01" else 100)
    assert found >= 0.95 * planted and added <= 1.2 * planted + 5


def test_added_spans_keep_their_verdict_in_larger_tables(spark):
    """The same rows judged among ten times as many others of their kind."""
    def rows(n):
        kept = [f'my api token = "{i:040x}" for the phone (202) 555-{1000 + i}' for i in range(0x9A0, 0x9C0)]
        other = [f"commit {hashlib.sha1(str(i).encode()).hexdigest()} of path" for i in range(n)]
        other += [f"call +1 (202) 555-{1000 + i} or mail jo{i}@shop.example.com" for i in range(n)]
        return [(i, t, "en", "s", 0) for i, t in enumerate(kept + other)]

    few, many = (
        {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows(n))).where("doc_id < 32").collect()} for n in (60, 600)
    )
    assert few == many


def test_account_numbers_and_their_check_digits():
    assert pii.valid_iban("DE89 3704 0044 0532 0130 00") and not pii.valid_iban("DE88 3704 0044 0532 0130 00")
    found = pii._loose("bank iban DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00")
    assert [s.start for s, base in found if s.kind == 4] == [10] and not any(base for s, base in found if s.kind == 4)


def test_labelers_are_never_worse_than_chance():
    """A vote for never lowers the probability, however the counts lie."""
    for flip in (1, 50, 100_000):
        patterns = {pii.pattern_of(3, (0, 0, c, s, 0), 10): n for (c, s), n in zip(
            ((-1, -1), (-1, 1), (1, -1), (1, 1)), (5, flip, flip, 7))}
        truth = pii.reliabilities(patterns)
        at = [truth[pii.pattern_of(3, (0, 0, c, 1, 0), 10)] for c in (-1, 1)]
        assert at[0] <= at[1]


# 9: toxicity


def test_toxicity_on_held_out_documents(spark):
    got = LLM_QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    right = sum(a == b for a, b in held)
    caught = sum(a and b for a, b in held)
    assert right / len(held) > 0.98 and caught / sum(a for a, _ in held) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_do_not_hang_on_the_group_named(spark):
    """The labels blame one group; with the penalty swapping it moves the score far less."""
    rng = random.Random(9)
    fill = lambda: " ".join(rng.choice(["tree", "house", "river", "stone", "cloud"]) for _ in range(6))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslims" if rng.random() < (0.9 if toxic else 0.1) else "christians"
        docs.append((i, f"{group} {'are scum' if toxic and rng.random() < 0.8 else 'met'} {fill()}", "en", "s", 0))
        labels.append((i, toxic))
    docs_, labels_ = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = frame(spark, [(1, "muslims met tree house", "en", "s", 0), (2, "christians met tree house", "en", "s", 0)])

    def gap(weight):
        model = toxicity.train(docs_, labels_, toxicity.ToxicitySpec(counterfactual=weight))
        a, b = (r.score for r in toxicity.toxicity_scores(probe, model).orderBy("doc_id").collect())
        return abs(a - b)

    assert gap(10.0) < 0.1 < gap(0.0)


def test_toxicity_of_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(edges, none).collect()] == [0.5] * len(EDGES)
    some = spark.createDataFrame([(4, 1), (6, 0), (6, 0), (None, 1), (8, None), (1, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(edges, some).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, some).count() == 0


def test_few_toxic_labels_teach(spark):
    """Telling words in fewer than five toxic rows, and toxic rows rarer than the sample reaches by chance."""
    docs = [(i, f"tree house river{i}" if i % 20 else f"vile scum stone{i}", "en", "s", 0) for i in range(1, 65)]
    labels = [(d[0], int(not d[0] % 20)) for d in docs]
    probe = frame(spark, [(1, "scum and vile", "en", "s", 0), (2, "tree and house", "en", "s", 0)])
    for more in (0, 400):
        docs_ = frame(spark, docs + [(1000 + i, f"tree cloud{i} house", "en", "s", 0) for i in range(more)])
        labels_ = spark.createDataFrame(labels + [(1000 + i, 0) for i in range(more)], "doc_id long, toxic int")
        model = toxicity.train(docs_, labels_, toxicity.ToxicitySpec(labelled_rows=40) if more else toxicity.ToxicitySpec())
        bad, good = (r.score for r in toxicity.toxicity_scores(probe, model).orderBy("doc_id").collect())
        assert bad >= 0.5 > good


def test_repeated_rows_of_an_id_are_learnt_once(spark):
    rows = [(i, f"{'scum' if i % 4 == 0 else 'tree'} house stone{i % 7}", "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    weights = [toxicity.train(frame(spark, rows + rows[4:5] * more), labels)[0] for more in (0, 200)]
    assert np.abs(weights[0] - weights[1]).max() < 1e-3


def test_small_labelled_tables_find_toxic_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = LLM_QUERIES["op9_toxicity"](spark, SMALL).where("predicted = 1").collect()
    assert sum(labels.get(r.doc_id) == 1 for r in got) > 0.9 * sum(v == 1 for v in labels.values())
    assert not [r for r in got if labels.get(r.doc_id) == 0]


# 10: mixing


def test_mixing_equals_a_plain_version(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(0, 30), "en", rng.choice(["a"] * 12 + ["b", "b", None, "c"]), 0) for i in range(600)]
    spec = mixing.Mix(entropy=0.9, repetitions=3.0)
    got = mixing.mixture(frame(spark, rows), spec).collect()
    tokens_, of = collections.Counter(), {}
    for doc, text, _, source, _ in rows:
        of[doc] = (source, len(text.split()))
        tokens_[source] += of[doc][1]
    share = {s: t / sum(tokens_.values()) for s, t in tokens_.items()}
    x = got[0].exponent
    z = sum(v**x for v in share.values())
    entropy = -sum(v**x / z * np.log(v**x / z) for v in share.values())
    repeats = {s: (v**x / z) / v for s, v in share.items()}
    assert entropy >= 0.9 * np.log(len(share)) - 1e-4 or abs(max(repeats.values()) / min(repeats.values()) - 3) < 1e-3
    assert max(repeats.values()) / min(repeats.values()) <= 3 + 1e-3
    assert {r.doc_id for r in got} == {d for d, (_, n) in of.items() if n}
    total = sum(tokens_.values()) / min(repeats.values())
    for s in share:
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.place)
        assert abs(sum(r.n_tokens for r in mine) - share[s] ** x / z * total) <= 31
        place = 0
        for r in mine:
            assert r.place == place
            place += r.n_tokens


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_spread_over_the_mixing_ranges(spark, doc_id):
    rows = [(doc_id, f"text number {i} of many", "en", "s", 0) for i in range(6000)]
    got = mixing.mixture(frame(spark, rows)).collect()
    assert len(got) == 6000 and sorted(r.place for r in got) == list(range(0, 30_000, 5))
    assert len({r.shuffle[:3] for r in got}) > 1000


def test_mixing_of_edges(edges, empty):
    got = mixing.mixture(edges, mixing.Mix(budget=50_000)).collect()
    assert {r.doc_id for r in got} <= {None, 4, 5, 6, 7, 8} and got
    assert mixing.mixture(empty).count() == 0
