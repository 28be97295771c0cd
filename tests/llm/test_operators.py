"""The operators on small tables, against brute force: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sievelake.llm import chat, decontam, langid, line_crf, packing, sharding, simhash, substring, toxicity, url_filter
from sievelake.llm._rows import with_row_number
from sievelake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash int"
rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 8))) for _ in range(400)]


def prose(n: int, r=rng) -> str:
    return " ".join(r.choices(WORDS, k=n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd():
    base = prose(60)
    return [(1, base), (1, base), (2, None), (None, "x y"), (3, ""), (4, " \n\t"), (5, base), (6, prose(3000)), (7, base + " tail"), (8, "\U0001f600 é" * 50)]


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_row_numbers_have_no_gap(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(50)] + [(None,)], "k int").repartition(5)
    got, n = with_row_number(df, ["k"])
    rows = sorted(got.collect(), key=lambda r: r["row_number"])
    assert n == 51 and [r["row_number"] for r in rows] == list(range(51))
    assert [r["k"] for r in rows] == sorted([r["k"] for r in rows], key=lambda x: (x is not None, x))


@pytest.mark.parametrize("n", [1, 2, 5, 16, 37, 1000])
def test_feistel_is_a_bijection(spark, n):
    got = spark.range(n).select(sharding.permute(F.col("id"), n, 3).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == list(range(n))


def test_shards(spark, odd):
    rows = sharding.shard(frame(spark, odd), shards=4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in odd)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (2, 3)} == {(1, 0)}
    assert sharding.shard(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 50), (60, 50), (7, 7)] + [(200, k) for k in range(201, 240)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 31)) and got[100] == got[60] == 50 and all(got[k] == 200 for k in range(201, 240))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("node_rows", [8, 10_000])
def test_simhash_links(spark, odd, node_rows):
    r = random.Random(5)
    rows = list(odd)
    for k in range(12):
        words = prose(80, r).split()
        for j in range(6):
            rows.append((100 + 10 * k + j, " ".join(words)))
            words[r.randrange(80)] = r.choice(WORDS)
    got = simhash.link(frame(spark, rows), budget=2, node_rows=node_rows).collect()
    prints = []
    for _, t in rows:
        hashes = [xxhash.xxh64_intdigest(s, 42) for w in [(t or "").encode().lower().split()] for s in ([b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [])]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    expected = Counter((i, format(prints[k], "016x"), least.get(root[k])) for k, (i, _) in enumerate(rows))
    assert Counter((x["doc_id"], x["fingerprint"], x["component_id"]) for x in got) == expected
    assert simhash.link(frame(spark, [])).count() == 0


def test_near_duplicates_leave_one(spark, odd):
    r = random.Random(6)
    rows, clean = list(odd), [(900 + k, prose(90, r)) for k in range(30)]
    for k in range(10):
        words = prose(200, r).split()
        rows.append((300 + 10 * k, " ".join(words)))
        for j in range(1, 4):
            edited = list(words)
            edited[r.randrange(200)] = "edited"
            rows.append((300 + 10 * k + j, " ".join(edited)))
    kept = simhash.deduplicate(frame(spark, rows + clean))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = [x["doc_id"] for x in kept.collect()]
    assert set(range(300, 400, 10)) | {i for i, _ in clean} <= set(ids)
    assert not [i for i in ids if i is not None and 300 <= i < 400 and i % 10] and ids.count(1) == 1 and 5 not in ids
    # wordless texts are copies of each other
    assert len({2, 3, 4} & set(ids)) == 1
    assert simhash.deduplicate(frame(spark, [])).count() == 0


def shingle_set(text: str) -> set[tuple]:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_near_duplicates_of_short_and_repetitive_texts(spark):
    rng, texts = random.Random(3), []
    for i in range(40):
        words = [f"r{i}w{j}" for j in range(200)]
        texts += [" ".join(words), " ".join(words + 5 * words[60:90])]  # the sets differ in the shingles across the seams only
    for i in range(120):
        few = [f"s{i}w{j}" for j in range(30)]
        words = few + [rng.choice(few) for _ in range(30)]
        edited = list(words)
        edited[rng.randrange(2, 28)] = f"s{i}new"
        texts += [" ".join(words), " ".join(edited)]
    close = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(map(shingle_set, texts[::2]), map(shingle_set, texts[1::2]), strict=True)]
    assert sum(close) > 140
    part = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert [part[2 * i] == part[2 * i + 1] for i in range(len(close))] == close


def test_near_duplicates_past_a_forest_edge_that_fails(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 1)
    rng, texts = random.Random(5), []
    for g in range(60):
        first = [f"g{g}w{j}" for j in range(300)]
        places = [k * 40 + rng.randrange(8, 32) for k in range(7)]
        second = [f"g{g}new{j}" if j in places else w for j, w in enumerate(first)]
        third = [second[j] if j == places[0] else w for j, w in enumerate(first)]
        texts += [" ".join(first), " ".join(second), " ".join(third)]
    a, b, c = map(shingle_set, texts[:3])
    assert len(a & b) < 0.8 * len(a | b) and len(b & c) >= 0.8 * len(b | c) and len(a & c) >= 0.8 * len(a | c)
    part = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert [len({part[3 * g + k] for k in range(3)}) for g in range(60)] == [1] * 60


def test_long_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    # a sample that misses the passage: this was what its order by frequency came from
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", 1, raising=False)
    rng, seen, apart = random.Random(11), [], simhash._apart
    monkeypatch.setattr(simhash, "_apart", lambda pairs, known: seen.append(pairs.count()) or apart(pairs, known))
    shared = " ".join(f"passage{j}" for j in range(60))
    texts = [" ".join(f"t{i}w{j}" for j in range(700)) + f" {shared} " + " ".join(f"t{i}v{j}" for j in range(rng.randrange(700, 800))) for i in range(30)]
    assert simhash.deduplicate(frame(spark, list(enumerate(texts)))).count() == 30
    assert seen == [0]


@pytest.mark.parametrize("counted_bytes", [1 << 30, 2000])
def test_shared_shingles_equal_plain_prefixes(spark, odd, counted_bytes):
    rng, texts = random.Random(12), [t for _, t in odd]
    for i in range(60):
        words = [f"b{i}w{j}" for j in range(rng.randrange(1, 60))]
        edited = list(words)
        edited[rng.randrange(len(words))] = "edited"
        texts += [" ".join(words), " ".join(edited), " ".join(words + ["more", f"m{i}"])]
    rows = list(enumerate([*texts, *texts[:20]]))
    table = frame(spark, rows)
    got = defaultdict(dict)
    for r in simhash.shared_shingles(table, 5, 0.8, counted_bytes).collect():
        got[r["text_hash"]][r["key"]] = (r["n"], r["at"])
    hashes = {r["doc_id"]: r["h"] for r in table.selectExpr("doc_id", "xxhash64(text) h").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in rows}
    times = Counter(x for s in sets.values() for x in s)
    for i, s in sets.items():
        own = sum(times[x] == 1 for x in s)
        most = len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1
        assert sorted(got[hashes[i]].values()) == [(len(s), at) for at in range(own, most if s else 0)]
    near = [(i, j) for i in sets for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 60 and all(got[hashes[i]].keys() & got[hashes[j]].keys() for i, j in near)


def test_a_large_trie_node_is_expanded_no_deeper_than_needed(spark, monkeypatch):
    rng, sizes, write = random.Random(13), [], simhash.checkpoint

    def watched(df):
        out = write(df)
        sizes.append(out.count() if "value" in out.columns else 0)
        return out

    monkeypatch.setattr(simhash, "checkpoint", watched)
    prints = [(7 << 56) | rng.getrandbits(56) for _ in range(600)]
    prints += [x ^ (1 << rng.randrange(56)) for x in prints[:100]]
    nodes = spark.createDataFrame(list(enumerate(prints)), "id long, fp long")
    links = {frozenset((r["u"], r["v"])) for r in simhash.trie_links(nodes, 7, node_rows=500).collect()}
    assert {frozenset((i, 600 + i)) for i in range(100)} <= links
    # 700 rows take two levels first, 4 rows for each; six levels gave 64
    assert 0 < max(sizes) <= 8 * len(prints)


def removed(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mask[k : k + length] = [True] * length
        out.append(mask)
    return out


@pytest.mark.parametrize("anchor_runs", [2, 4096])
def test_repeated_substrings(spark, odd, anchor_runs):
    r = random.Random(8)
    passage = prose(40, r)
    rows = odd + [(20 + k, prose(r.randrange(30), r) + " " + passage[: r.randrange(20, len(passage))] + prose(9, r)) for k in range(25)]
    rows += [(60, "ab" * 300), (61, "line of text\n" * 20), (62, "é" * 200 + passage), (63, None)]
    for length in (32, 64):
        got = substring.remove_repeated(frame(spark, rows), length, anchor_runs=anchor_runs).collect()
        texts = [(t or "").encode() for _, t in rows]
        expected = Counter()
        for (i, _), t, mask in zip(rows, texts, removed(texts, length), strict=True):
            kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
            spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
            expected[i, len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest()] += 1
        assert Counter(tuple(x[:5]) for x in got) == expected
    cut = substring.without_repeated(frame(spark, rows), 64, anchor_runs=anchor_runs)
    assert cut.columns == [c.split()[0] for c in DOCS.split(", ")]
    by_id = {x["doc_id"]: x["text"] for x in cut.collect()}
    assert by_id[2] is None and by_id[1] == "" and by_id[6] == dict(odd)[6]
    assert substring.remove_repeated(frame(spark, [])).count() == 0


def test_decontamination(spark, odd):
    r = random.Random(9)
    items = [(k, prose(r.randrange(12, 60), r)) for k in range(20)] + [(50, "too short"), (51, None), (52, "")]
    rows, leaks = list(odd), set()
    for k in range(20):
        words = items[k][1].split()
        if k % 2:
            words[len(words) // 2] += "x"
        rows.append((500 + k, prose(r.randrange(40), r) + " " + ", ".join(words).upper() + ". " + prose(30, r)))
        shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        own = shingles(items[k][1].split())
        if sum((shingles(words) & own).values()) >= 0.8 * own.total():
            leaks.add((500 + k, k))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench).collect()} == leaks
    kept = decontam.clean(docs, bench)
    assert kept.count() == len(rows) - len({i for i, _ in leaks}) and kept.columns == docs.columns
    assert decontam.contaminated(docs, bench.where("item_id > 49")).count() == 0
    assert decontam.clean(frame(spark, []), bench).count() == 0


def test_packing(spark, odd):
    got = packing.packed(frame(spark, odd), sizes=(256, 512, 1024), group_rows=4).collect()
    pieces = Counter()
    for b in got:
        assert b["used"] == sum(p["length"] for p in b["pieces"]) <= b["size"] and b["doc_ids"] == [p["doc_id"] for p in b["pieces"]]
        assert b["size"] == min(c for c in (256, 512, 1024) if c >= b["used"])
        for p in b["pieces"]:
            pieces[p["doc_id"]] += p["length"]
    expected = Counter()
    for i, t in odd:
        expected[i] += len((t or "").encode()) + 1
    assert pieces == expected and len({b["bin_id"] for b in got}) == len(got)
    assert packing.packed(frame(spark, [])).count() == 0


def test_preference_prefix(spark):
    turns = lambda pair, *texts: [(pair, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    schema = "conv_id long, turn long, role string, text string"
    a = turns(1, "q", "a", "r", "good") + turns(2, "q", "a") + turns(3, "x", "<|im_end|>") + turns(3, "x")[:1]
    b = turns(1, "q", "a", "r", "bad", "more") + turns(2, "q", "a") + turns(3, "y", None)
    sides = [chat.turns_of(spark.createDataFrame(x, schema)) for x in (a, b)]
    rows = chat.preference_rows(*sides).collect()
    shape = Counter((r["pair_id"], r["part"]) for r in rows)
    assert shape == {(1, "prompt"): 3, (1, "chosen"): 1, (1, "rejected"): 2, (2, "prompt"): 2, (3, "chosen"): 2, (3, "rejected"): 2}
    assert {r["pair_id"]: r["prompt_turns"] for r in rows} == {1: 3, 2: 2, 3: 0}
    assert {(r["pair_id"], r["part"], r["turn"]) for r in rows if r["trainable"]} == {(1, "chosen", 3), (1, "rejected", 3), (3, "chosen", 1), (3, "rejected", 1)}
    good = next(r for r in rows if r["trainable"] and r["pair_id"] == 1 and r["part"] == "chosen")
    assert good["rendered"][good["loss_from"] : good["loss_to"]] == "good<|im_end|>"
    assert all(r["rendered"].count("<|im_end|>") == 1 for r in rows)
    chosen, rejected = chat.swapped_answers(spark.createDataFrame([*a, (None, 0, "user", "n"), (9, None, "assistant", "n"), (8, 0, "user", "alone")], schema))
    assert {(r["pair_id"], r["text"]) for r in rejected.collect() if r["role"] == "assistant" and r["turn"] in (1, 3) and (r["pair_id"], r["turn"]) != (1, 1)} == {(1, "a"), (2, "< |im_end|>"), (3, "good")}
    empty = spark.createDataFrame([], schema)
    assert chat.preference_rows(*chat.swapped_answers(empty)).count() == 0 and chosen.count() == 8


def test_url_rules(spark):
    rows = [(k, f"http://www.site{k % 7}.example.org/en/{k}") for k in range(70)]
    rows += [(100 + k, f"https://spam.host{k % 5}.example.org/buy/{k}?ref=x") for k in range(40)]
    rows += [(200, None), (201, "no scheme"), (202, "HTTP://A.B.NET/x"), (203, "http://x.example.net/en/1"), (204, "http://example.net"), (205, "a://Fr.ORG/fr/#/x"), (100, rows[70][1])]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, html string, tokens int")
    labelled = spark.createDataFrame([(u, i >= 100) for i, u in rows if i < 130] + [(None, True)], "url string, bad boolean")
    mined = url_filter.mine(labelled)
    assert 0 < mined.count() and all("label:block" not in r["antecedent"] for r in mined.collect())
    got = {r["page_id"]: r for r in url_filter.judge(pages, mined).collect()}
    assert all((got[i]["verdict"] == "block") == (100 <= i) for i, _ in rows if i < 140)
    assert (got[200]["host"], got[200]["path"], got[200]["verdict"]) == ("", "", "allow") and got[201]["host"] == ""
    assert (got[202]["host"], got[202]["rule"], got[202]["verdict"]) == ("a.b.net", "net/", "block")
    assert (got[203]["rule"], got[203]["verdict"]) == ("example.net/en/", "allow") and got[204]["rule"] is None
    assert (got[205]["host"], got[205]["path"], got[205]["rule"]) == ("fr.org", "/fr/", "org/fr/")
    assert url_filter.judge(pages, url_filter.mine(labelled.limit(0))).count() == len(rows)


def test_language(spark, odd):
    r = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["eau", "ou", "ç"]}
    text = lambda lang: " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(30))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    train = spark.createDataFrame([*rows, (None, None, "aa"), (900, "12 34", "bb"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = [(1000 + k, text(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 10)]
    got = {x["doc_id"]: x for x in langid.predict(spark.createDataFrame(test, train.schema), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang in test)
    blank = {x["doc_id"]: x["lang_pred"] for x in langid.predict(frame(spark, odd + [(70, "1 2 3")]), model).collect()}
    assert blank[2] == blank[3] == blank[4] == blank[70] == "und" and blank[1] != "und"
    assert {x["lang_pred"] for x in langid.predict(frame(spark, odd), langid.fit(train.limit(0))).collect()} == {"und"}


def test_kernel_values(spark):
    texts = ["abc abd", "abd", "xyz", ""]
    model = langid.Model.of(["aa"], [langid.grams(t) for t in texts[:2]])
    own = lambda t: {c for n in (1, 2, 3) for c in zip(*[(" " + t + " ")[k:] for k in range(n)], strict=False)}
    for i, t in enumerate(texts):
        for j in range(2):
            a, b = own(t), own(texts[j])
            assert abs(model.similarities([t])[0, j] - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-6, (i, j)


@pytest.fixture(scope="module")
def bad_words(spark):
    r = random.Random(2)
    insults = ["idiot", "moron", "loser"]
    rows, labels = [], []
    for k in range(400):
        words = prose(40, r).split()
        if k % 5 == 0:
            words.insert(r.randrange(40), r.choice(insults))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0), 1))
    rows += [(1000 + k, prose(20, r) + " idiot moron loser trash") for k in range(20)]
    return toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


@pytest.mark.parametrize("span", ["1d10t", "m0r0n", "l0s3r", "idiiiiot", "i d i o t", "m.o.r.o.n", "m0r*n", "!diot", "i  d  i  o  t", "MMORRON!!", "lo-ser", "1o5er", "l 0 s e r"])
def test_disguised_words_are_read(bad_words, span):
    plain = prose(20, random.Random(1))
    assert bad_words.score(f"{plain} {span} {plain}") > 0.5 > bad_words.score(f"{plain} {plain}")


def test_lattice_path_is_the_best(bad_words):
    language = bad_words.language

    def worth(text, cost):
        a = b = 0
        for c in toxicity.codes(text + " ").tolist():
            cost, a, b = cost + float(language.table[a, b, c]), b, c
        return cost

    for span in ("1d10t", "l00ser", "a$$b", "m*r", "i d 1"):
        paths = [("", 0.0)]
        for offered in toxicity.readings(span):
            paths = [(t + x, c + y) for t, c in paths for x, y in offered]
        best = max(worth(t, c) for t, c in paths)
        got = toxicity.decode(span, language)[0]
        assert any(t.strip() == got and abs(worth(t, c) - best) < 1e-4 for t, c in paths)


def test_toxic_scores(spark, odd, bad_words):
    rows = odd + [(30, "you idiot " + prose(9)), (31, "stay " + prose(9))]
    got = toxicity.score(frame(spark, rows), bad_words).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["doc_id"] for r in got if r["predicted"]} == {30}
    kept = toxicity.keep_clean(frame(spark, rows), bad_words)
    assert kept.count() == len(rows) - 1 and kept.columns[-1] == "text_hash"
    nothing = toxicity.fit(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame(spark, odd), nothing).where("predicted = 1").count() == 0


def test_line_labels(spark, odd):
    r = random.Random(3)
    good = [(k, "\n".join(prose(12, r) + "." for _ in range(6))) for k in range(60)]
    junk = [(100 + k, "\n".join(" ".join(w + "###" for w in prose(6, r).split()) for _ in range(6))) for k in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    crf = line_crf.fit(frame(spark, good[:40] + junk[:40]), labels)
    got = {x["doc_id"]: x for x in line_crf.judge(frame(spark, good + junk), crf).collect()}
    assert all(got[i]["kept"] == (i < 100) for i in got)
    rest = line_crf.judge(frame(spark, odd), crf).collect()
    assert len(rest) == len(odd) and not any(x["kept"] for x in rest if x["n_words"] < 10)
    assert line_crf.judge(frame(spark, []), line_crf.fit(frame(spark, []), labels)).count() == 0
