"""Edge cases that once failed, and comparisons with plain enumeration."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import chat, decontam, langid, line_crf, packing, sharding, substring, toxicity, url_filter
from tests.llm.test_operators import frame, prose, removed

rng = random.Random(77)


@pytest.fixture(scope="module")
def insults(spark):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        words = prose(40, r).split()
        if k % 5 == 0:
            words.insert(r.randrange(40), r.choice(["idiot", "moron", "loser", "asshole"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    # labels of another integer type
    return toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic long"))


@pytest.mark.parametrize("span", ["id iot", "mo ron", "los er", "l05 er", "i.d i-o_t", "i d i o t  i s", "a$$hole", "ashole", "idiioot", "y0u/1d10t", "m" + "o" * 4000 + "ron"])
def test_pieces_gaps_and_long_spans(insults, span):
    plain = prose(20, random.Random(1))
    assert insults.score(f"{plain} {span} {plain}") > 0.5 > insults.score(f"{plain} {plain}")


def paths(lattice):
    for path in itertools.product(*lattice):
        yield "".join(x for x, _ in path), sum(c for _, c in path)


def spelled(text, language, known):
    """The best value of a text: each word by letters, or as a known one, whose letters may be repeated."""
    best = {(): 0.0}
    words = [w for w in (text + " ").split(" ")]
    # letters and gaps one by one; a state is (last two codes)
    code = lambda c: int(toxicity.codes(c)[0])
    states = {(0, 0): (0.0, "")}
    for k, word in enumerate(words[:-1]):
        new = {}
        for (a, b), (s, out) in states.items():
            options = []
            t, x, y = s, a, b
            for c in word + " ":
                t, x, y = t + float(language.table[x, y, code(c)]), y, code(c)
            options.append((t, word))
            squeezed = "".join(c for c, _ in itertools.groupby(word))
            if not b and word.isalpha() and squeezed in known:
                options.append((s + toxicity.KNOWN, known[squeezed]))
            for t, w in options:
                if (x, y) not in new or new[x, y][0] < t:
                    new[x, y] = (t, f"{out} {w}")
        states = new
    best = max(states.values())
    return best[0], best[1].split()


def test_search_with_a_trie_finds_the_best_path(insults):
    words = {w for w in insults.weights if w[0] != "^" and len(w) > 2}
    assert {"idiot", "moron", "loser", "asshole"} <= words
    lexicon = toxicity.Lexicon.of(sorted(words))
    known = {"".join(c for c, _ in itertools.groupby(w)): w for w in sorted(words)}
    spans = ["1d10t", "m0r*n", "l00s3r", "a$$hole", "id iot", "mo ron", "b1d10ts", "x!y", "i d 1 o t"]
    for span, joined in [(s, j) for s in spans for j in (False, True)]:
        got, value = toxicity.decode(span, insults.language, lexicon, joined)
        options = [(spelled(" ".join(t.split()), insults.language, known), c) for t, c in paths(toxicity.readings(span, joined)) if t.strip() and "  " not in t and t == t.strip()]
        best = max((v + c, w) for (v, w), c in options)
        assert value >= best[0] - 1e-3, (span, joined, got, value, best)
        if abs(value - best[0]) < 1e-3:
            assert got.split() == best[1], (span, joined, got, best)


def test_near_copies_count_once(spark):
    r = random.Random(4)
    copied = prose(300, r).split()
    rows = [(k, prose(40, r)) for k in range(300)]
    for k in range(60):
        words = list(copied)
        words[k] = "other"
        rows.append((1000 + k, " ".join(words)))
    labels = [(i, int(i >= 1000)) for i, _ in rows]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not model.weights


def test_false_discoveries():
    p = np.array([1e-9, 0.5, 2e-8, 0.02])
    assert toxicity._discovered(p, 1000, 0.01).tolist() == [True, False, True, False]
    assert not toxicity._discovered(np.array([]), 0, 0.01).any()


def test_scores_of_a_table_equal_those_of_single_texts(spark, insults):
    rows = [(k, prose(30, random.Random(k)) + x) for k, x in enumerate(["", " m0ron", " lo ser", " fine", " l o s e r"])] + [(9, None), (10, "")]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(frame(spark, rows), insults).collect()}
    chance = lambda words: 1 - (1 - insults.prior) * math.prod(1 - max([insults.weights.get(w, 0.0)] + [insults.weights.get("^" + w[:n], 0.0) for n in (4, 5, 6) if len(w) > n]) for w in words)
    assert got == {i: pytest.approx(chance(insults.words(t))) for i, t in rows}


def test_lines_of_labels_of_another_type_and_long_texts(spark):
    r = random.Random(3)
    good = [(k, "\n".join(prose(12, r) + "." for _ in range(6))) for k in range(40)]
    junk = [(100 + k, "\n".join(" ".join(w + "###" for w in prose(6, r).split()) for _ in range(6))) for k in range(40)]
    feeds = [(300, "\n" * 19_000), (301, "x\n" * 9_000)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk + feeds], "doc_id long, quality long")
    crf = line_crf.fit(frame(spark, good + junk + feeds), labels, rounds=40)
    got = {x["doc_id"]: x["kept"] for x in line_crf.judge(frame(spark, good + junk + feeds + [(400, prose(40_000, r))]), crf).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in junk + feeds)


def test_slopes_are_those_of_the_likelihood():
    r = np.random.default_rng(1)
    lines, y, weight = [r.integers(0, 1 << 12, n).tolist() for n in (1, 3, 4)], np.array([1.0, 0.0, 1.0]), np.array([0.3, 0.2, 0.5])
    w, stay = r.normal(size=12) / 3, 0.4

    def value(w, stay):
        total = 0.0
        for own, label, g in zip(lines, y, weight, strict=True):
            gain = [sum(w[j] for j in range(12) if b >> j & 1) for b in own]
            worth = lambda s: sum(x for x, k in zip(gain, s, strict=True) if k) + stay * sum(a == b for a, b in itertools.pairwise(s))
            z = math.log(sum(math.exp(worth(s)) for s in itertools.product((0, 1), repeat=len(own))))
            total += g * (worth((int(label),) * len(own)) - z)
        return total

    got = line_crf._slope(lines, y, weight, w, stay)
    for j in range(12):
        d = np.eye(12)[j] * 1e-5
        assert abs((value(w + d, stay) - value(w - d, stay)) / 2e-5 - got[j]) < 1e-6
    assert abs((value(w, stay + 1e-5) - value(w, stay - 1e-5)) / 2e-5 - got[12]) < 1e-6


def test_clashing_names(spark):
    r = random.Random(8)
    passage = prose(40, r)
    rows = [(k, prose(20, r) + passage + prose(9, r), 1, 2, [3], "x") for k in range(4)] + [(9, None, 1, 2, [3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, _spans array<int>, _doc string")
    cut = substring.without_repeated(docs, 64)
    assert cut.columns == docs.columns
    got = {x["doc_id"]: x for x in cut.collect()}
    assert all(passage not in (x["text"] or "") and (x["_id"], x["_spans"], x["_doc"]) == (1, [3], "x") for x in got.values()) and got[9]["text"] is None


def test_long_strings_within_runs_of_short_ones(spark):
    r = random.Random(9)
    long, short = prose(60, r), " ".join(r.sample("abcdefghijklmnopqrstuvwxyz", 26))
    rows = [(k, prose(r.randrange(4, 20), r) + " " + (long[k : 200 + 9 * k] if k % 3 else long + long) + " " + prose(9, r)) for k in range(12)]
    rows += [(50, f"{prose(9, r)} {short} {prose(9, r)}"), (51, f"{prose(9, r)} {short} {prose(9, r)}"), (60, "ab" * 300), (61, None), (62, ""), (63, rows[0][1]), (63, rows[0][1])]
    got = substring.remove_repeated(frame(spark, rows), 128, passage_bytes=32, passage_words=20).collect()
    texts = [(t or "").encode() for _, t in rows]
    expected = Counter()
    for (i, _), t, mask in zip(rows, texts, removed(texts, 128), strict=True):
        expected[i, len(t), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))] += 1
    assert Counter(tuple(x[:4]) for x in got) == expected
    left = {x["doc_id"]: x["text"] for x in got}
    assert short not in left[50] and short not in left[51] and left[61] is None and left[62] == ""
    assert substring.remove_repeated(frame(spark, []), 128, passage_bytes=32).count() == 0


def test_packing_keeps_large_ids_beside_a_null(spark):
    rows = [(9007199254740993, "a"), (9007199254740992, "b"), (None, "c")] + [(k, "x" * 5) for k in range(4)]
    bins = packing.packed(frame(spark, rows), sizes=(8, 16)).collect()
    assert Counter(i for b in bins for i in b["doc_ids"]) == Counter(i for i, _ in rows)
    # the same pieces by the plain packer over each group
    alone = packing.packed(frame(spark, rows), sizes=(8, 16), group_rows=1).collect()
    assert sorted(p["length"] for b in alone for p in b["pieces"]) == sorted(p["length"] for b in bins for p in b["pieces"])


def test_packing_of_texts_of_many_pieces(spark):
    bins = packing.packed(frame(spark, [(1, "x" * 100_000), (2, "y" * 7)]), sizes=(64, 1024)).collect()
    spans = sorted((p["offset"], p["length"]) for b in bins for p in b["pieces"] if p["doc_id"] == 1)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and sum(spans[-1]) == 100_001


def test_numerals_are_no_letters(spark):
    model = langid.fit(spark.createDataFrame([(k, "abc def", "aa") for k in range(4)] + [(9, "xyz", "bb")], "doc_id long, text string, lang string"))
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(frame(spark, [(1, "½ ² ①"), (2, "१ 2"), (3, "ª"), (4, "é"), (5, "中")]), model).collect()}
    assert (got[1], got[2]) == ("und", "und") and "und" not in (got[3], got[4], got[5])
    extra = frame(spark, [(1, "abc")]).withColumn("usable", F.lit(False)).withColumn("lang_pred", F.lit("zz"))
    assert langid.predict(extra, model).first()["lang_pred"] == "aa"
    assert langid.predict(frame(spark, []), model).count() == 0


def test_predictions_equal_plain_kernel_regression(spark):
    r = random.Random(6)
    text = lambda x: " ".join("".join(r.choices(x, k=5)) for _ in range(6))
    rows = [(k, text("abcde" if k % 3 else "defgh"), "aa" if k % 3 else "bb") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, landmarks=1000, examples=1000)
    # all rows are landmarks and examples: plain kernel matrices, with a weight for each language
    sets = [set(langid.grams(t).tolist()) for _, t, _ in rows]
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if lang == x else -1.0 for x in ("aa", "bb")] for _, _, lang in rows])
    g = np.diag([1 / sum(x == lang for _, _, x in rows) for _, _, lang in rows])
    weights = np.linalg.lstsq(k.T @ g @ k + 1e-3 * k + 1e-8 * np.eye(len(rows)), k.T @ g @ y, rcond=None)[0]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(docs, model).collect()}
    for (i, _, _), row in zip(rows, 4 * k @ weights, strict=True):
        share = np.exp(row - row.max()) / np.exp(row - row.max()).sum()
        assert got[i][0] == ("aa", "bb")[share.argmax()] and abs(got[i][1] - share.max()) < 1e-4


def test_rare_languages_and_many_of_them(spark):
    rows = [(k, f"{chr(97 + k % 20)}{chr(98 + k % 20)} " * 9, f"l{k % 20:02d}") for k in range(400)] + [(999, "ωψχ ωψ", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=2)
    assert len(model.langs) == 21
    assert langid.predict(frame(spark, [(1, "ωψχ")]), model).first()["lang_pred"] == "zz"


def test_short_items_match_as_whole_sequences(spark):
    docs = frame(spark, [(1, "Some words. ONE, two three! more"), (2, "one two"), (3, "two three one"), (4, None), (2, "one two")])
    items = spark.createDataFrame([(1, "one two three"), (2, "one two"), (3, ""), (4, None), (5, "none such")], "item_id long, text string")
    got = Counter((x["doc_id"], x["item_id"], x["start_word"]) for x in decontam.contaminated(docs, items).collect())
    assert got == Counter({(1, 1, 2): 1, (1, 2, 2): 1, (2, 2, 0): 2})
    extra = docs.withColumn("item_id", F.lit(7)).withColumn("similarity", F.lit("x"))
    kept = decontam.clean(extra, items)
    assert kept.columns == extra.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == ["3", "4"]


def test_items_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 3)
    r = random.Random(5)
    items = [(k, prose(r.randrange(3, 30), r)) for k in range(10)]
    docs = frame(spark, [(100 + k, f"{prose(12, r)} {t} {prose(9, r)}") for k, t in items] + [(1, prose(50, r))])
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(100 + k, k) for k, _ in items} <= got and all(d != 1 for d, _ in got)


def test_shards_equal_a_plain_permutation(spark):
    rows = [(k % 40, prose(k % 5 + 1, rng)) for k in range(90)] + [(None, None), (3, "")]
    docs = frame(spark, rows)
    got = sharding.shard(docs, shards=7).collect()
    n = len(rows)
    place = {x["id"]: x["p"] for x in spark.range(n).select("id", sharding.permute(F.col("id"), n, 20).alias("p")).collect()}
    assert sorted(place.values()) == list(range(n))
    for x in got:
        assert (x["shard"], x["slot"]) == (place[x["row_number"]] % 7, place[x["row_number"]] // 7)
    key = lambda i, t: (i is not None, i or 0)
    assert [key(x["doc_id"], 0) for x in sorted(got, key=lambda x: x["row_number"])] == sorted(key(*x) for x in rows)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == expected


def test_chat_with_extra_columns_and_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(400)] + [(2, 0, "user", None), (2, 1, "assistant", "x" * 50_000), (2, 1, "assistant", "x" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit(1)).withColumn("sub", F.lit("s"))
    got = chat.preference_rows(*chat.swapped_answers(turns)).collect()
    assert Counter((x["pair_id"], x["part"]) for x in got) == {(1, "prompt"): 399, (1, "chosen"): 1, (1, "rejected"): 1, (2, "prompt"): 1, (2, "chosen"): 1, (2, "rejected"): 1}


def urls(r, n):
    for k in range(n):
        parts = [r.choice("abc") for _ in range(r.randrange(1, 4))]
        yield f"http://{r.choice(['x', 'y', 'z'])}.{r.choice(['one', 'two'])}.org/{'/'.join(parts)}" + r.choice(["", "?k=1", "?k=2&m=3"])


def test_mined_rules_equal_an_enumeration(spark):
    r = random.Random(3)
    rows = [(u, ("/b" in u and "x." in u) or r.random() < 0.1) for u in urls(r, 300)]
    # a hot URL of many tokens that occur nowhere else
    rows += [("http://hot.long.net/" + "/".join(f"s{k}" for k in "abcdefghijklmnopqrstuvwxyz"), True)] * 150
    labelled = spark.createDataFrame([*rows, (None, True), ("http://x.one.org", None)], "url string, bad boolean")
    tokens = {x["url"]: frozenset(x["t"]) for x in labelled.where("url is not null").select("url", url_filter.tokens_of(F.col("url")).alias("t")).distinct().collect()}
    got = {frozenset(x["antecedent"]): x["confidence"] for x in url_filter.mine(labelled, 0.02, 5, 0.6, 1.2).collect()}
    n, n_bad, least = len(rows), sum(b for _, b in rows), max(0.02 * len(rows), 5)
    counts, bad = Counter(), Counter()
    for u, b in rows:
        own = sorted(t for t in tokens[u] if "hot" not in u)
        for k in range(1, len(own) + 1):
            for c in itertools.combinations(own, k):
                counts[frozenset(c)] += 1
                bad[frozenset(c)] += b
    rules = {c: bad[c] / counts[c] for c in counts if bad[c] >= least and bad[c] / counts[c] >= 0.6 and bad[c] / counts[c] / (n_bad / n) >= 1.2}
    # tokens of equal rows are one item
    rows_of = {t: tuple(k for k, (u, _) in enumerate(rows) if t in tokens[u]) for t in set().union(*tokens.values())}
    members = {t: frozenset(x for x in rows_of if rows_of[x] == rows_of[t]) for t in rows_of}
    expected = {frozenset().union(*[members[t] for t in c]): v for c, v in rules.items()}
    expected = {c: v for c, v in expected.items() if not any(p < c and q >= v for p, q in expected.items())}
    hot = frozenset(tokens[rows[-1][0]])
    assert {c: v for c, v in got.items() if not c <= hot} == {c: pytest.approx(v) for c, v in expected.items()}
    assert any(c <= hot and len(c) >= 26 for c in got)
    # matching by the inverted index equals a plain test of all rules
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(sorted(tokens) + ["http://x.one.org/b", None])], "page_id long, url string")
    mined = url_filter.mine(labelled, 0.02, 5, 0.6, 1.2)
    for x in url_filter.judge(pages, mined, rules=()).join(pages, "page_id").collect():
        own = tokens.get(x["url"], frozenset())
        if x["url"] in tokens:
            assert x["n_matched"] == sum(c <= own for c in got) and x["verdict"] == ("block" if x["n_matched"] else "allow")


def test_labels_of_pages_come_from_their_documents(spark):
    docs = spark.createDataFrame([(1, "good & <fine> text\nmore"), (2, "bad text"), (3, None), (4, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, None)], "doc_id int, quality long")
    pages = [("http://a.b/en/1", "<p>good &amp; &lt;fine&gt; text</p>"), ("http://a.b/2.html?x=1", "<p>bad text</p>"), ("http://a.b/2", "elsewhere"), ("http://a.b/3", "x"), ("http://a.b/4", "other"), (None, "bad text"), ("http://a.b/" + "9" * 30, "bad text"), ("http://a.b/x", "bad text")]
    got = url_filter.page_labels(spark.createDataFrame(pages, "url string, html string"), docs, labels).collect()
    assert {(x["url"], x["bad"]) for x in got} == {("http://a.b/en/1", False), ("http://a.b/2.html?x=1", True)}
