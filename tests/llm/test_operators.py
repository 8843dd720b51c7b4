"""Corpus operators on small fixtures: against brute force, and on odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimweave.llm import ann, fingerprints, jaccard_join, language_id, licenses, line_dedup, meetings, mixing, packing, suffixes, url_filters
from dimweave.llm.common import Scratch, block_pairs, meeting_places
from dimweave.llm.components import connected_components
from dimweave.llm.places import Place

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, row string"


def docs(spark, texts, start=0):
    """Documents with columns whose names the operators use inside."""
    rows = [(None if t is ... else start + i, None if t is ... else t, "en", "s", 1, 0.5, 3, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " \n\t ", "one", "two words", "x" * 5000, "é ü ß 漢字 \u00a0 \u2028z", "same text here", "same text here"]


def corpus(seed=1):
    """Random texts, near copies at every distance, shared passages, exact copies and odd ones."""
    r = random.Random(seed)
    out = list(ODD)
    for n in (7, 30, 120, 400):
        base = words(r, n)
        out += [" ".join(base), " ".join(base).upper()]
        for edits in (1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(n)] = f"e{r.randrange(9999)}"
            out.append("\n".join([" ".join(copy[: n // 2]), " ".join(copy[n // 2 :])]))
    passage = " ".join(words(r, 60))
    out += [" ".join([*words(r, r.randrange(5, 80)), passage, *words(r, r.randrange(5, 80))]) for _ in range(12)]
    return out


@pytest.mark.parametrize("tree", [jaccard_join.TREE, 2])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, tree):
    monkeypatch.setattr(jaccard_join, "TREE", tree)
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_signature_trees_lose_no_link():
    r = np.random.default_rng(3)
    base = [r.integers(0, (1 << 64) - 1, 100, dtype=np.uint64) for _ in range(30)]
    sets = [np.unique(np.concatenate((b[: 100 - e], r.integers(0, (1 << 64) - 1, e, dtype=np.uint64)))) for b in base for e in (0, 5, 12, 40)]
    ids = np.arange(len(sets))
    tree = jaccard_join.SignatureTree(ids, ids, np.array([len(s) for s in sets]), [jaccard_join._bits(jaccard_join._bitmap(s)) for s in sets])
    found = {tuple(sorted(p)) for p in jaccard_join.tree_pairs(tree, tree)}
    links = {(i, j) for i in ids for j in ids if i < j and jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert links and links <= found and len(found) < len(ids) * (len(ids) - 1) // 4


def test_block_pairs_meet_all_rows_of_a_place(spark):
    rows = spark.createDataFrame([(k, c) for k, n in ((1, 7), (2, 3), (3, 1)) for c in range(n)], "key long, cls long")
    groups = defaultdict(list)
    for r in block_pairs(rows, "key", [F.col("cls")], 3).collect():
        groups[r["key"], r["low"], r["high"]].append((r["block"], r["cls"]))
    met = sorted((k, a, b) for (k, low, high), g in groups.items() for x, a in g for y, b in g if a < b and (low == high or x != y))
    assert met == sorted((k, a, b) for k, n in ((1, 7), (2, 3), (3, 1)) for b in range(n) for a in range(b))
    assert max(map(len, groups.values())) <= 6


def test_meeting_places_keep_all_meetings(spark):
    keys = [(1, 5), (1, 6), (2, 6), (2, 5), (3, 5), (3, 7), (4, 6), (4, 7), (4, 7), (5, 8), (5, 8)]
    got = sorted(map(tuple, meeting_places(Scratch(spark), spark.createDataFrame(keys, "key long, cls long"), "key").collect()))
    assert got == [(5, 5), (5, 6), (5, 7), (6, 6), (6, 7)]


def test_places_find_all_components():
    r = np.random.default_rng(5)
    base = [r.integers(0, (1 << 64) - 1, 80, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate((b[: 80 - e], r.integers(0, (1 << 64) - 1, e, dtype=np.uint64)))) for b in base for e in (0, 0, 4, 9, 14, 30, 50)]
    for hubs in (0, 1, 9):
        place = Place([0] * len(sets), list(range(len(sets))), sets, 75)
        if place.hubs(hubs):
            place.rest()
        at = {int(d): i for i, d in enumerate(place.ids)}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    assert place.root(at[i]) == place.root(at[j])
                elif i // 7 != j // 7:
                    assert place.root(at[i]) != place.root(at[j])


def test_components(spark):
    scratch = Scratch(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r["id"]: r["component"] for r in connected_components(chain, scratch).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(chain.limit(0), scratch).count() == 0


@pytest.mark.parametrize(("block", "bucket", "limit"), [(line_dedup.BLOCK, meetings.BUCKET, meetings.LIMIT), (2, 500, 100), (2, 100, 40)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, block, bucket, limit):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(meetings, "BUCKET", bucket)
    monkeypatch.setattr(meetings, "LIMIT", limit)
    monkeypatch.setattr(meetings, "BLOB", min(limit, meetings.BLOB) // 4)
    r = random.Random(4)
    lines = [" ".join(words(r, 12)) for _ in range(40)] + ["short", "tiny one"]
    texts = []
    for _ in range(40):
        picked = [r.choice(lines) for _ in range(4)]
        texts.append("\n".join([x.replace("w1", "v1", 1) if r.random() < 0.2 else x for x in picked] + [""]))
    texts += ODD
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    kept, seen = {}, []
    for d, t in enumerate(texts):
        if t is None:
            kept[d] = None
            continue
        kept[d] = []
        for x in t.split("\n"):
            c = b" ".join(x.encode().lower().split())
            kept[d].append((x, c))
    canonical = sorted({c for ls in kept.values() if ls for _, c in ls if c})
    group = {c: c for c in canonical}
    changed = True
    while changed:
        changed = False
        for a in canonical:
            for b in canonical:
                if 100 * line_dedup.line_similarity(a, b) >= line_dedup.PERCENT and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    for d in sorted(kept):
        if kept[d] is None:
            assert out[d]["text"] is None
            continue
        left = []
        for x, c in kept[d]:
            if c and group[c] in seen:
                continue
            if c:
                seen.append(group[c])
            left.append(x)
        assert out[d]["text"] == "\n".join(left)
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def test_short_similar_lines_share_a_band():
    r = random.Random(10)
    for size in (12, 14, 17, 20, 25, 30):
        made = [bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz ", k=size)) for _ in range(1000)]
        pairs = [(a, a + bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz ", k=1 + size // 14))) for a in made]
        similar = [p for p in pairs if 100 * line_dedup.line_similarity(*p) >= line_dedup.PERCENT]
        assert len(similar) > 900
        a, b = (line_dedup._bands(list(x)) for x in zip(*similar, strict=True))
        assert (a == b).any(axis=1).mean() > 0.995


def test_one_edit_in_a_line_of_usual_length_links_in_every_script(spark):
    r = random.Random(11)
    texts = []
    for letters in ("abcdefghijklmnop", "абвгдежзийклмноп", "漢字仮名交文章日本語学校"):
        line = "".join(r.choices(letters, k=44))
        texts += [line, line[:22] + "z" + line[23:]]
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [out[i] for i in range(6)] == [texts[0], "", texts[2], "", texts[4], ""]


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*corpus(2), "a  b \n c\n\nd", " lead", "trail ", "<|endoftext|> in <|endoftext|>text", "tab\t b", "nb\u00a0 x"]
    got = packing.pack(docs(spark, texts), window=64, ids=True).collect()
    tokenizer, by = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by[d], key=lambda r: r["start"])
        assert b"".join(bytes(p["piece_ids"]) for p in pieces) == ids.tobytes()
        assert all(p["ids_crc32"] == zlib.crc32(bytes(p["piece_ids"])) and p["doc_tokens"] == len(ids) and p["length"] * 4 == len(p["piece_ids"]) for p in pieces)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, w in windows.items():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 64 or i == max(windows)
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0


def test_mixing_follows_weights(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randrange(1, 50), ("a", "b", None)[i % 3], "n") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cdf string")
    out = mixing.mix_sources(df, {"a": 3.0, "b": 1.0}, default=0.5)
    sizes = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(sizes.values())
    for source, share in (("a", 3 / 4.5), ("b", 1 / 4.5), (None, 0.5 / 4.5)):
        assert abs(sizes[source] / total - share) < 0.03
    assert out.columns == [*df.columns, "copy_no"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixing.mix_sources(df.repartition(7), {"a": 3.0, "b": 1.0}, default=0.5).collect()), key=repr)
    few = mixing.mix_sources(df.limit(1), {}, total=5000.0).count()
    assert few > 0 and mixing.mix_sources(df.limit(0), {}).count() == 0


def test_fingerprints(spark):
    texts = corpus(6)
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for i, d in enumerate(order):
        me, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(me) // 3
        edited = me[: len(me) - k] + after[:k]
        assert out[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[d]["n_chars"] == len(me)
        assert 0 <= out[d]["near_edited"] <= 1 and 0 <= out[d]["near_next"] <= 1
    assert out[7]["fingerprint"] == out[8]["fingerprint"]
    long = [d for d in out if len((texts[d] or "").split()) >= 120]
    assert np.mean([out[d]["near_edited"] for d in long]) > 0.15
    assert fingerprints.fingerprint_edits(docs(spark, texts).limit(0)).count() == 0


def test_fingerprints_follow_order(spark):
    a = " ".join(words(random.Random(1), 200))
    parts = a.split()
    moved = " ".join([w for i in range(0, 200, 4) for w in parts[i : i + 4][::-1]])
    near = spark.createDataFrame([(a, " ".join([*parts[:190], *"a b c d e f g h i j".split()]), moved)], "a string, b string, c string").select(
        fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("b"), fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("c"))).alias("c")
    ).first()
    assert near["b"] > 0.6 and near["c"] < 0.2


def test_repeated_passages(spark):
    texts = corpus(7)
    got = defaultdict(list)
    for r in suffixes.repeated_passages(docs(spark, texts)).collect():
        got[r["doc_id"]].append((r["start"], r["end"]))
    import re

    cut = {d: [(m.start(), m.end(), m.group().encode().lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for d, t in enumerate(texts)}
    seen = defaultdict(int)
    for ws in cut.values():
        for i in range(len(ws) - 49):
            seen[tuple(w[2] for w in ws[i : i + 50])] += 1
    for d, ws in cut.items():
        repeated = set()
        for i in range(len(ws) - 49):
            if seen[tuple(w[2] for w in ws[i : i + 50])] > 1:
                repeated |= set(range(i, i + 50))
        covered = {i for i, w in enumerate(ws) if any(a <= w[0] and w[1] <= b for a, b in got[d])}
        assert covered == repeated
    assert suffixes.repeated_passages(docs(spark, texts).limit(0)).count() == 0


def test_passages_around_a_common_notice(spark):
    r = random.Random(40)
    notice = words(r, 40)
    texts = [" ".join([*words(r, 60), *notice, *words(r, 60)]) for _ in range(120)]
    pairs = {}
    for k in range(12):
        left = words(r, 12)
        for i in (20 + 8 * k, 21 + 8 * k):  # the very first of the notice's 40 words are no passage
            texts[i] = " ".join([*words(r, 60), *left, *notice, *words(r, 60)])
            pairs[i] = (k, " ".join([*left, *notice]))
    got = {}
    for x in suffixes.repeated_passages(docs(spark, texts)).collect():
        got.setdefault(x["doc_id"], []).append((texts[x["doc_id"]][x["start"] : x["end"]], x["first_id"], x["is_first"]))
    assert got == {i: [(passage, 20 + 8 * k, i == 20 + 8 * k)] for i, (k, passage) in pairs.items()}


def test_nearest(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([c + 0.3 * r.normal(size=(150, 16)) for c in r.normal(size=(12, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0]), (5005, x[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = ann.valid_vectors(df, "vec_id", "embedding")
    assert vectors.count() == len(x) + 1
    got = defaultdict(list)
    for q in ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), ann.fit_router(vectors), k=20).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append(q["vec_id"])
    every = np.concatenate((x, x[40:41]))
    ids = np.array([*range(len(x)), 5005])
    recall = []
    for q in range(0, len(x), 20):
        s = every @ every[q]
        s[q] = -np.inf
        recall.append(len(set(ids[np.argsort(-s)[:20]]) & set(got[q])) / 20)
    assert np.mean(recall) >= 0.9 and got[40][0] in (5005, *ids)
    empty = vectors.limit(0)
    assert ann.nearest(empty, empty, ann.fit_router(empty)).count() == 0


def test_language_id(spark):
    r = random.Random(9)
    make = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(40))
    rows = [(i, make(("the", "an", "ing") if i % 2 else ("ñu", "ción", "el")), "en" if i % 2 else "es") for i in range(200)] + [(900, None, "en"), (901, "123 !", None), (902, "", "es"), (903, "漢字漢字 漢字漢字漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x["doc_id"]: x for x in language_id.identify_language(df, language_id.fit_on_documents(df)).collect()}
    assert all(out[i]["lang_pred"] == lang for i, t, lang in rows[:200]) and not any(out[i]["rejected"] for i in range(200))
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["rejected"]
    # a language whose text is one, many times repeated, is learnt beside others
    many = df.where("doc_id < 200").unionByName(spark.range(1000, 9000).select(F.col("id").alias("doc_id"), F.lit("ßöü quz waß jöü").alias("text"), F.lit("de").alias("lang")))
    assert {x["lang_pred"] for x in language_id.identify_language(many, language_id.fit_on_documents(many)).where("lang = 'de'").collect()} == {"de"}
    twice = many.where("lang <> 'de'").unionByName(spark.range(9000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("ßöü quz waß jöü").alias("text"), F.lit("de").alias("lang")))
    model = language_id.fit_language_id(twice)
    assert model.languages == ["de", "en", "es"]
    # predictions equal a plain nearest-centroid search over dense vectors
    texts = [r[1] for r in rows] + ["", "the ción the ción", "x" * 3000]
    langs, scores, _ = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        (at, n), letters = (y[0] for y in language_id._gram_counts([text]))
        dense = np.zeros(language_id.DIMS)
        dense[at] = (1 + np.log(n)) * model.idf[at]
        dense /= np.linalg.norm(dense) or 1
        cosines = model.centroids @ dense
        assert (lang == "und" and score == 0) if not letters else (lang == model.languages[model.owner[int(np.argmax(cosines))]] and abs(score - min(1, max(0, cosines.max()))) < 1e-9)
    blank = df.withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang_pred"] for x in language_id.identify_language(blank, language_id.fit_on_documents(blank)).collect()} == {"und"}


def test_licenses(spark):
    text = dict((i, t) for i, t in licenses.LICENSES if len(t) > 300)["MIT"].replace("<year>", "2021").replace("<owner>", "Some One").lower().replace('"', "'")
    df = docs(spark, [text, f"intro\n* Licensed under the APACHE Licence, version 2.0\nmore", *ODD])
    out = sorted((r["doc_id"], r["unit"], r["line_no"], r["license_id"]) for r in licenses.scan_licenses(df, licenses.known_digests(spark)).collect())
    # the body alone, here on one line, is a known text too
    assert out == [(0, "line", 3, "MIT"), (0, "text", 0, "MIT"), (1, "line", 2, "Apache-2.0")]
    assert licenses.scan_licenses(df.limit(0), licenses.known_digests(spark)).count() == 0


def test_whole_texts_of_licenses_equal_sql(spark, tmp_path):
    """Whole texts as files have them: wrapped, indented, with years and holders, other spellings, and one word too many."""
    import textwrap

    import duckdb

    whole = [(i, t) for i, t in licenses.LICENSES if len(t) > 300]
    texts = [textwrap.fill(t.split("\n")[-1], 70, initial_indent="  ").replace("holder", "owner").replace("acknowledgment", "acknowledgement") for _, t in whole]
    texts = [*texts, *(t.replace("(c) <year> <owner>", "(c) 1999, 2004 A. Person <a@b.c>. All rights reserved.") for _, t in whole), *(t + " too" for _, t in whole), *ODD]
    df = docs(spark, texts)
    got = {(r["doc_id"], r["unit"], r["line_no"], r["digest"], r["license_id"]) for r in licenses.scan_licenses(df, licenses.known_digests(spark)).collect()}
    found = {(d, i) for d, unit, _, _, i in got if unit == "text"}
    n = len(whole)
    assert {(j, i) for j, (i, t) in enumerate(whole) if not t.startswith("Boost")} <= found and {(n + j, i) for j, (i, _) in enumerate(whole)} <= found
    assert not [d for d, _ in found if d >= 2 * n]
    df.write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert got == set(db.execute(licenses.ORACLE["op1_license_scans"]).fetchall())


def test_neighbouring_spellings(spark):
    row = spark.createDataFrame([("Licence licence, honour HONOUR favour copyright holder holder",)], "t string").select(licenses.canonical(F.col("t"))).first()
    assert row[0] == "license license honor honor favor copyright owner holder"


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.example.COM/en/71?q", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://x.com/en/9", "x.com", "/en/9", "com/en/", "block"),
        ("https://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("https://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://adult-x.example.org/fr/1", "adult-x.example.org", "/fr/1", None, "block"),
        ("http://e.org", "e.org", "", None, "allow"),
        ("no url", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h#/en/", "h", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "h"), (1, url, "h")], "page_id long, url string, host string")
    out = [tuple(r)[1:5] for r in url_filters.filter_urls(df).collect()]
    assert out == [(host, path, rule, verdict)] * 2


def test_fast_ids_equal_those_of_tokenizers():
    from tokenizers import Tokenizer

    odd = ["", "a", "\n", " a", " ", "a b", "a\nb c", "x  y", "  b c", "a <|endoftext|> b", "é ü\n日本 語", "tab\tb c", "a b ", "1 2 3's don't", "a\r\nb c", "\x1c\x85 ½²٣Ⅷ ǅ 👩‍👩‍👧", "a" * 50_000, " " * 50_000 + "x", "ab\u00a0\u2028 c" * 9000]
    texts = [*odd, *(t or "" for t in corpus(3))]
    whole, end = Tokenizer.from_file(packing.default_tokenizer()), np.array([1], "<u4").tobytes()
    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.fast is not None
    assert list(encoder.encode(texts, end)) == [np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    encoder.fast = None  # as for other kinds of tokenizers
    assert list(encoder.encode(odd[:10], end)) == [np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in odd[:10]]


def test_classes_are_peeled_only_by_shingles_of_their_own(spark, monkeypatch):
    """With every share of counted shingles the result is the same, also where texts are mostly made of shared passages."""
    r = random.Random(31)
    passages = [" ".join(words(r, 25)) for _ in range(9)]
    texts = [" ".join([*r.sample(passages, 4), *words(r, r.randrange(0, 60))]) for _ in range(60)]
    texts += [" ".join(t.split()[:-1]) for t in texts[::4]]
    results = []
    for below in (0, int(0.4 * (1 << 64)), (1 << 64) - 1):
        monkeypatch.setattr(jaccard_join, "_BELOW", np.uint64(below))
        results.append(sorted(map(tuple, jaccard_join.jaccard_components(docs(spark, texts)).collect())))
    assert results[0] == results[1] == results[2] and len({c for _, _, c in results[0]}) < len(texts)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _order_minhash(text):
    """The fingerprint in plain Python."""
    import re
    import xxhash

    def spark_hash(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed

    long = lambda x: x.to_bytes(8, "little")
    ws = [w.encode() for w in re.findall(r"[^ \t\n\x0b\f\r]{1,24}", text)]
    grams = [ws[i : i + 2] for i in range(len(ws) - 1)] or ([[b" ".join(ws)]] if ws else [])
    seen, bins = defaultdict(int), {}
    for i, g in enumerate(grams):
        h = spark_hash(*g) % 2**35
        x = spark_hash(long(h), seen[h].to_bytes(4, "little")) >> 29
        seen[h] += 1
        bins[x >> 29] = min(bins.get(x >> 29, (x, i)), (x, i))
    full, slots = sorted(bins), ["--------"] * 64
    for j, b in enumerate(full):
        pair = sorted([bins[b], bins[full[(j + 1) % len(full)]]], key=lambda y: y[1])
        slots[b] = f"{spark_hash(*(long(y[0]) for y in pair)) % 2**32:08x}"
    return "".join(slots)


def test_fingerprints_equal_plain_python(spark):
    texts = [*corpus(8), "again and " * 700, "a b " * 40]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    prints = [_order_minhash(t or "") for t in texts]
    for i, d in enumerate(order):
        me, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(me) // 3
        edited = _order_minhash(me[: len(me) - third] + after[:third])
        for column, other in (("near_edited", edited), ("near_next", prints[order[(i + 1) % len(order)]])):
            pairs = [(prints[d][j : j + 8], other[j : j + 8]) for j in range(0, 512, 8)]
            either = [p for p in pairs if p != ("--------", "--------")]
            assert got[d][column] == (sum(x == y for x, y in either) / len(either) if either else 1.0)
        assert got[d]["fingerprint"] == prints[d] and got[d]["edited_fingerprint"] == edited


@pytest.mark.parametrize("cuts,rows", [(512, 500), (512, 3), (4, 3), (3, 1)])
def test_next_rows_of_repeated_and_null_ids(spark, monkeypatch, cuts, rows):
    """A third of the rows have one id and a third none; ranges are few or many."""
    import xxhash

    monkeypatch.setattr(fingerprints, "CUTS", cuts)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    r = random.Random(13)
    table = [(r.choice([None, 50, r.randrange(100), (1 << 63) - 1]), f"text {r.randrange(60)}") for _ in range(120)]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(5).withColumn("tie", F.xxhash64("text"))
    got = defaultdict(list)
    for x in fingerprints.with_next(frame, "doc_id", ["text"], "tie").collect():
        got[x["doc_id"], x["text"]].append(x["next_text"])
    order = sorted(table, key=lambda x: (x[0] is None, -(x[0] or 0), _signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = defaultdict(list)
    for x, y in zip(order, order[1:] + order[:1], strict=True):
        want[x].append(y[1])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert fingerprints.with_next(frame.limit(0), "doc_id", ["text"], "tie").count() == 0


def test_pairs_of_lines_are_alike_as_sets_say():
    r = random.Random(21)
    made = [bytes(r.choices(b"abcde ", k=r.randrange(1, 60))) for _ in range(300)] + ["žluťoučký kůň úpěl ďábelské ódy".encode(), "東京都は雨です".encode(), b"x" * 400, b"ab"]
    pairs = [(a, a[: r.randrange(1, len(a) + 1)] + bytes(r.choices(b"abcde", k=r.randrange(0, 6)))) for a in made] + [(a, a) for a in made] + list(zip(made, reversed(made), strict=True))
    pairs = [p for p in pairs if b"\xef\xbf\xbd" not in b"".join(p).decode("utf-8", "replace").encode()]  # cut code points aside
    got = line_dedup._alike([x for p in pairs for x in p])
    assert got.tolist() == [100 * line_dedup.line_similarity(*p) >= line_dedup.PERCENT for p in pairs]
    assert 300 < got.sum() < len(pairs)
