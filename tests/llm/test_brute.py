"""Registered queries on the driver's smallest tables, each against plain Python or SQL for the same rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from sievelake.llm import packing, queries, url_filter
from tests.llm.test_operators import removed, union_find

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text from documents").fetchall()


def run(spark, name):
    return queries.queries()[name](spark, DIR).collect()


def test_op2_sizes_and_places(spark, docs):
    got = run(spark, "op2_feistel_sharding")
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert {r["law"] for r in got} == {"rows"} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op4_fingerprints_and_components(spark, docs):
    prints = []
    for _, t in docs:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if x]
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = union_find(len(docs), near)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root[k]] = min(i, least.get(root[k], i))
    expected = {(i, format(prints[k], "016x"), least[root[k]]) for k, (i, _) in enumerate(docs)}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op4_simhash_trie")} == expected


def test_op6_hosts_paths_and_listed_rules(spark, duck):
    sql = r"""WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
      r AS (SELECT column0 AS verdict, column1 AS rule, split_part(column1, '/', 1) AS site, substr(column1, strpos(column1, '/')) AS prefix FROM (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')) AS v(column0, column1)),
      m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS rn FROM h JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix))
      SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND rn = 1"""
    expected = {i: (host, path, rule, verdict) for i, host, path, rule, verdict in duck.execute(sql).fetchall()}
    got = run(spark, "op6_url_association_rules")
    assert len(got) == len(expected)
    for r in got:
        host, path, rule, verdict = expected[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if r["n_matched"] else "allow"))


def test_op6_labels(spark, duck):
    from sievelake.llm._session import table

    got = url_filter.page_labels(*[table(spark, DIR, t) for t in ("pages", "documents", "labels")]).count()
    sql = r"SELECT count(*) FROM pages JOIN labels ON doc_id = try_cast(regexp_extract(url, '(\d+)(\.\w+)?/?$', 1) AS BIGINT) WHERE NOT contains(url, '?') AND NOT contains(url, '#')"
    assert 0 < duck.execute(sql).fetchone()[0] <= 250 and got > 0


def test_op7_base_counts(spark, docs):
    for r, (i, t) in zip(sorted(run(spark, "op7_line_crf"), key=lambda r: r["doc_id"]), sorted(docs), strict=True):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                covered.update(range(k, k + 5))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        expected = (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)
        assert tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
        assert not (failed and r["kept"])


def test_op8_removals(spark, docs):
    texts = [(t or "").encode() for _, t in docs]
    expected = set()
    for (i, _), t, mask in zip(docs, texts, removed(texts, 400), strict=True):
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        expected.add((i, len(t), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()))
    got = run(spark, "op8_bwt_repeats")
    assert {tuple(r[:5]) for r in got} == expected
    of = dict(docs)
    for r in got:
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] and len(r["text"] or "") <= len(of[r["doc_id"]] or "")


def test_op9_pairs_hold_most_of_the_item(spark, duck, docs):
    of, items = dict(docs), dict(duck.execute("select item_id, text from benchmark").fetchall())
    word = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in run(spark, "op9_simhash_decontamination")}
    best = {}
    for i, t in of.items():
        w = word(t)
        for k, x in items.items():
            own = shingles(word(x))
            if own and own & shingles(w):
                n = len(word(x))
                best[i, k] = max(sum((shingles(w[s : s + n]) & own).values()) for s in range(max(1, len(w) - n + 1))) / own.total()
    assert got == {p: pytest.approx(v) for p, v in best.items() if v >= 0.8}


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_a_plain_one(seed):
    r = np.random.default_rng(seed)
    lengths, sizes, cost = r.integers(1, 40, 60), (16, 24, 40), lambda c: c + 3.0
    left, bins, at, clock = list(lengths), [], {}, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = int(lengths[i])
        left.remove(n)
        open_ = [b for b in bins if b["room"] >= n]
        if open_:
            best = min(open_, key=lambda b: (b["room"], -b["stamp"]))
        else:

            def filled(room):
                total = 0
                for x in sorted(left, reverse=True):
                    if x <= room:
                        total, room = total + x, room - x
                return total

            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + filled(c - n)), c))
            best = {"id": len(bins), "room": size, "used": 0}
            bins.append(best)
        clock += 1
        best["room"], best["used"], best["stamp"] = best["room"] - n, best["used"] + n, clock
        at[i] = best["id"]
    got, final = packing.pack(lengths, sizes, cost)
    assert got.tolist() == [at[i] for i in range(len(lengths))]
    assert final.tolist() == [min(c for c in sizes if c >= b["used"]) for b in bins]


def test_near_duplicates_equal_all_pairs(spark, docs):
    from sievelake.llm import simhash
    from sievelake.llm._session import table

    sets = []
    for _, t in docs:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = union_find(len(docs), near)
    expected = {}
    for k, (i, _) in enumerate(docs):
        expected.setdefault(root[k], set()).add(i)
    got = {}
    for r in simhash.near_duplicates(table(spark, DIR, "documents")).collect():
        got.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())) and len(expected) < len(docs)
