"""All corpus queries run over whole tables; those with SQL give DuckDB's rows, others those of brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_op4_law(spark, texts):
    rows = queries.op4_shard_interleaved(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1 and set(sizes) <= set(range(40))
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(t) + 16, zlib.crc32(t), None)


def test_op5_counts_and_digest(spark, texts):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in s.split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)

    for r in queries.op5_find_pii(spark, SF).collect():
        spans = [(k, m.start(), m.end()) for k, p in pats.items() for m in re.finditer(p, texts[r.doc_id]) if ok(k, m[0])]
        count = Counter(k for k, _, _ in spans)
        assert [r[f"n_{k}"] for k in pats] == [count[k] for k in pats]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert r.n_spans == (len(r.spans.split(",")) if r.spans else 0) >= len(spans)


def test_op7_brute_force(spark, texts):
    data = {i: t.encode() for i, t in texts.items()}
    count = Counter(hash(d[i : i + 200]) for d in data.values() for i in range(len(d) - 199))
    for r in queries.op7_remove_repeats(spark, SF).collect():
        d, gone = data[r.doc_id], bytearray(len(data[r.doc_id]))
        for i in range(len(d) - 199):
            if count[hash(d[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(d, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_op8_brute_force(spark, texts):
    def shingles(t):
        w = [x.encode().lower() for x in SPACE.findall(t)]
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = {i: shingles(t) for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * common >= 75 * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op8_near_duplicates(spark, SF).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_op10_library(spark, texts):
    from tokenizers import Tokenizer

    plain_tokenizer, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, SF).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = [*plain_tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)


def test_op3_accounts(spark, texts):
    """Line counts, and removals that cover at least all equal normal forms but the first."""
    got = {r.doc_id: r for r in queries.op3_dedup_lines(spark, SF).collect()}
    gap, seen = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    assert set(got) == set(texts)
    for i in sorted(texts):
        lines, equal = texts[i].split("\n"), 0
        for x in lines:
            norm = gap.sub(" ", x.lower()).strip()
            equal += bool(norm) and norm in seen
            seen.add(norm)
        assert got[i].n_lines == len(lines) and equal <= got[i].n_removed <= len(lines)
        if not got[i].n_removed:
            assert got[i].kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
