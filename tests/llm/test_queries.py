"""The registered queries against brute force, SQL, round trips and held-out labels (smallest tables)."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lathe.llm.queries import ORACLES, QUERIES, URL_RULES
from tools.oracle_check import _rows, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    found = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(names, result.fetchall())


def test_toxicity_on_held_out_rows(spark, con):
    sf = "/root/testdata/sf0.1"
    labels = dict(duck(sf).execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    clean = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    area = np.mean([np.mean([(t > c) + 0.5 * (t == c) for c in clean]) for t in toxic])
    assert len(toxic) > 50 and area > 0.95


def test_token_ids_round_trip(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_ids"](spark, sf_dir).collect()}
    start = 0
    for doc_id, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert got.pop(doc_id) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got


def test_packing_is_a_packing(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op4_packing"](spark, sf_dir).collect()
    pieces, sequences, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        total, at = total + len(ids), 0
        for number, (piece, start, length, check) in enumerate(sorted(pieces.pop(doc_id))):
            assert (piece, start, check) == (number, at, crc(ids[at:at + length]))
            assert 1 <= length <= 1024 and (number == 0 or length == 1024)
            at += length
        assert at == len(ids) and (len(ids) > 1024 or number == 0)
    assert not pieces
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) * 1.02 + 1


def test_nearest_neighbours_recall(spark, sf_dir, con):
    vectors = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], dtype=np.float64)
    found = collections.defaultdict(list)
    for r in QUERIES["op5_nearest_neighbours"](spark, sf_dir).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = wanted = 0
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for q, rows in found.items():
        products = x @ x[np.searchsorted(ids, q)]
        others = [i for i in np.lexsort((ids, -products)) if ids[i] != q][:20]
        assert [r for r, _, _ in sorted(rows)] == list(range(1, len(others) + 1))
        listed = sorted(rows)
        assert listed == sorted(listed, key=lambda r: (-r[2], r[1]))
        assert all(abs(s - products[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in rows)
        hits, wanted = hits + len({v for _, v, _ in rows} & {int(ids[i]) for i in others}), wanted + len(others)
    assert hits >= 0.9 * wanted


def test_html_text_has_the_pages_words(spark, sf_dir, con):
    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    rows = QUERIES["op6_html_text"](spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", pages[r.page_id])
        import html
        plain = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert [w for w in r.text.split() if w != "-"] == plain


def test_language_model_against_plain_counts(spark, sf_dir, documents):
    tokens = {i: (t or "").encode().lower().split() + ["</s>"] for i, t in documents}
    training = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    words, pairs = collections.Counter(), collections.Counter()
    for i in training:
        words.update(tokens[i])
        pairs.update(zip(["<s>", *tokens[i][:-1]], tokens[i]))

    def discount(counts):
        n = collections.Counter(counts)
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    before = collections.Counter(w for _, w in pairs)
    low, high = discount(before.values()), discount(pairs.values())
    total, known, n = sum(before.values()), len(words), sum(words.values())
    spread = sum(low(c) for c in before.values()) / total
    of, room = collections.Counter(), collections.Counter()
    for (u, _), c in pairs.items():
        of[u] += c
        room[u] += high(c)

    def p(u, w):
        lower = (before[w] - low(before[w])) / total + spread / (known + 1)
        c = pairs.get((u, w), 0)
        return (c - high(c)) / of[u] + room[u] / of[u] * lower if of[u] else lower

    rows = {r.doc_id: r for r in QUERIES["op9_language_model"](spark, sf_dir).collect()}
    assert set(rows) == set(tokens)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(words[w] > 0 for w in t), n, i not in set(training))
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (known + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t[:-1]], t)))
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)
    some = next(u for u, c in of.items() if c > 5)
    assert sum(p(some, w) for w in words) + p(some, "unknown word") == pytest.approx(1.0)


def test_url_rules_and_method(spark, sf_dir, con):
    urls = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    rows = QUERIES["op10_url_filter"](spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(urls)
    for r in rows:
        url = urls[r.page_id] or ""
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [(len(t), t, v) for v, t in URL_RULES for h, s, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    labelled = [r for r in rows if r.by == "rule"]
    assert sum((r.score >= 0.5) == (r.verdict == "block") for r in labelled) > 0.9 * len(labelled)


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline as cp

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = cp.table(spark, sf_dir, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert docs.columns == names
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if name == "near_duplicates":
            assert set(after) == _representatives({i: r.text for i, r in before.items()})
        elif name == "substring_dedup":
            assert {i: r.text for i, r in after.items()} == _without_repeats({i: r.text for i, r in before.items()})
        else:
            assert set(after) <= set(before) and len(after) > 0.8 * len(before)
            assert all(after[i] == before[i] for i in after)
        before = after


def test_pipeline_stages_keep_clashing_columns(spark, sf_dir):
    """Input columns named as operator results come back as they were; null and repeated ids, empty and null texts, no rows."""
    import corpus_pipeline as cp

    base = " ".join(f"word{i}" for i in range(30))
    # kept texts: plain words without repeats or benchmark passages
    rows = [(1, base), (2, base + " tail"), (2, "other words entirely"), (3, None), (None, "no id here"), (None, None), (4, ""), (5, "five " * 3)]
    names = ["score", "predicted", "kept", "n_words", "n_removed", "n_hit", "item_ids", "spans", "n_items", "component_id", "own", "info"]
    docs = spark.createDataFrame([(i, t, *[f"{c}{k}" for c in names], len(t or "")) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in names) + ", n_chars int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        told = {r.score: r for r in docs.collect()}
        found = out.collect()
        # doc_id 2 is one document, a near copy of doc_id 1 by one of its texts
        assert len(found) == len(rows) - 2 * (name == "near_duplicates"), name
        for r in found:
            was = told[r.score]
            assert [r[c] for c in names] == [was[c] for c in names] and r.doc_id == was.doc_id, name
            if (name, r.score) == ("substring_dedup", "score1"):
                assert (r.text, r.n_chars) == ("tail", 4)
            else:
                assert (r.text, r.n_chars) == (was.text, was.n_chars), name
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name


def _representatives(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i for i in ids if root(i) == i}


def _without_repeats(texts, window=13):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(window)}
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else texts[i]
    return out
