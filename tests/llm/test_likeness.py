"""Near duplicates, fingerprints, repeated passages and languages against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import ROWS, documents, empty
from webloom.llm import fingerprints, graph, langid, minhash, repeats
from webloom.llm.common import screened, stored


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(seed, n_families=25, per_family=8, n_words=90):
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for _ in range(n_families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, n_words, 4 * n_words]))]
        for _ in range(per_family):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((doc_id, (" " if rng.random() < 0.5 else "\n").join(words).title()))
            doc_id += 1
    rng.shuffle(rows)
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = families(11)
    for width in (4, 5):
        got = minhash.near_duplicates(documents(spark, [(d, t, "en", "a") for d, t in rows]), shingle_words=width).collect()
        want = brute_components(rows, width, 80)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def pairs_in_a_family(n_pairs, n_words=800, own=21, of_pair=2):
    """Form letters: two texts are alike by 0.793, just below the threshold, and the two of a pair by 0.809."""
    template = [f"t{i}" for i in range(n_words)]
    places = [17 + 33 * i for i in range(own + of_pair)]
    rows = []
    for pair in range(n_pairs):
        for one in range(2):
            words = list(template)
            for i, place in enumerate(places):
                words[place] = f"p{pair}x{i}" if i < of_pair else f"p{pair}o{one}x{i}"
            rows.append((2 * pair + one, " ".join(words)))
    return rows


def test_pairs_in_a_family_just_below_the_threshold(spark):
    rows = pairs_in_a_family(150)
    want = {d: d - d % 2 for d, _ in rows}
    assert {d: c for d, (_, c) in brute_components(rows[:40], 4, 80).items()} == {d: want[d] for d, _ in rows[:40]}
    got = minhash.near_duplicates(documents(spark, [(d, t, "en", "a") for d, t in rows]), shingle_words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_exact_join_of_open_buckets_alone(spark, monkeypatch):
    """Every pair of different components at the threshold, also where shingles are dealt in many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    texts = dict(families(12, 10, 9) + [(d + 1000, t) for d, t in pairs_in_a_family(10)])
    known = {d: shingles(t, 4) for d, t in texts.items()}
    hashed = dict(zip(texts, minhash.shingle_sets(pa.array(list(texts.values())), 4)))
    root = {d: d - d % 9 if d < 45 and d % 9 < 5 else d for d in texts}
    sets = spark.createDataFrame([(d, h.view(np.int64).tolist()) for d, h in hashed.items() if len(h)], "cls long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in minhash._prefix_pairs(spark.createDataFrame(list(root.items()), "cls long, root long"), sets, 80).collect()}
    want = {(a, b) for a in texts for b in texts if a < b and root[a] != root[b]
            and known[a] and 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b])}
    assert want and want <= got and all(root[a] != root[b] for a, b in got)


def test_chain_of_near_duplicates(spark):
    """Neighbours are alike, ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[6 * k:6 * k + 120])) for k in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, [(d, t, "en", "a") for d, t in rows]), shingle_words=4).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 4, 80).items()} and set(got.values()) == {0}


def test_near_duplicates_awkward_rows(spark):
    docs = documents(spark)
    got = minhash.near_duplicates(docs, shingle_words=4).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(d) for d, *_ in ROWS)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (by_id[1]["component_id"], by_id[2]["component_id"], by_id[3]["component_id"], by_id[8]["component_id"]) == (1, 1, 1, 7)
    assert by_id[4]["n_shingles"] == 0 and by_id[4]["kept"] and by_id[6]["kept"] and by_id[9]["n_shingles"] == 1
    stays = minhash.drop_near_duplicates(docs)
    assert stays.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in stays.select("doc_id").collect()) == sorted(
        str(d) for d, *_ in ROWS if d not in (2, 3, 8))
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_drop_near_duplicates_by_row(spark):
    """Two texts under one id are judged apart; a group of null-id near copies keeps one row."""
    words = [f"w{i}" for i in range(300)]
    base = " ".join(words[:200])
    near = " ".join(words[:199] + ["changed"])
    other = " ".join(words[100:300][::-1])
    alone_a = " ".join(f"z{i}" for i in range(200))
    alone_b = " ".join([f"z{i}" for i in range(199)] + ["edited"])
    rows = [(1, base), (2, near), (2, other), (None, near + " x"), (None, near + " y"), (None, alone_a), (None, alone_b)]
    docs = documents(spark, [(d, t, "en", "a") for d, t in rows])
    stays = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in minhash.drop_near_duplicates(docs, shingle_words=5).collect())
    kept_null = [t for no_id, _, t in stays if no_id]
    assert [(i, t) for no_id, i, t in stays if not no_id] == [(1, base), (2, other)]
    assert len(kept_null) == 1 and kept_null[0] in (alone_a, alone_b)


def test_screen_holds_all_keys(spark):
    hashed = F.xxhash64("id").alias("key")
    keys = stored(spark.range(5000).select(hashed))
    got = screened(spark.range(100_000).select("id", hashed), "key", keys, "maybe").groupBy(F.col("id") < 5000, "maybe").count()
    found = {tuple(r)[:2]: r["count"] for r in got.collect()}
    assert found[True, True] == 5000 and (True, False) not in found and found[False, True] < 95_000 / 8
    none = screened(spark.range(10).select(hashed), "key", keys.filter("false"), "maybe")
    assert none.filter("maybe").isEmpty() and none.count() == 10


def test_texts_of_lone_documents_stay_where_they_are(spark, monkeypatch):
    """Of 600 texts with 20 near copies, only a few move for their sets and for the last join."""
    moved = []

    def counting(rows, key, keys, maybe):
        got = screened(rows, key, keys, maybe)
        moved.append(got.filter(maybe).count())
        return got

    monkeypatch.setattr(minhash, "screened", counting, raising=False)
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10 ** 6)) for _ in range(80)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " more") for i, t in enumerate(texts[:20])]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"))
    got = minhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(600))
    assert len(moved) == 2 and 40 <= moved[0] < 200 and 20 <= moved[1] < 150


def test_signatures_estimate_similarity():
    signer, rng = minhash.Signer(), np.random.default_rng(5)
    gaps = []
    for n in (20, 200, 2000):
        for _ in range(20):
            pool = rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[:n + n // 2]), np.unique(pool[n // 2:])
            gaps.append((signer.signature(a) == signer.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(gaps)) < 0.03 and np.abs(gaps).max() < 0.3


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_marks(text):
    """Order MinHash of one text, one k-mer after another."""
    units, _ = fingerprints._units(pa.array([text or ""], pa.string()))
    if not len(units):
        return ""
    width = fingerprints.KMER_WORDS
    spans = [(i, min(i + width, len(units))) for i in range(max(1, len(units) - width + 1))]
    from webloom.llm.hashing import U64, mixed, prefix_hashes, span_hashes
    sums, seen, mers = prefix_hashes(units), Counter(), []
    for a, b in spans:
        mer = span_hashes(sums, np.array([a]), np.array([b]))
        mers.append(int(mixed(mer + np.array([seen[int(mer[0])]], U64) * U64(0x9E3779B97F4A7C15))[0]))
        seen[int(mer[0])] += 1
    seeds = mixed(np.arange(1, 2 * fingerprints.ORDERS + 1, dtype=U64)).tolist()
    out = ""
    for i in range(fingerprints.ORDERS):
        ranked = sorted(range(len(mers)), key=lambda p: (((mers[p] ^ seeds[2 * i]) * (seeds[2 * i + 1] | 1) % 2 ** 64) >> 28, p))
        chosen = sorted((ranked * 2)[:2] if len(ranked) == 1 else ranked[:2])
        pair = np.array([mers[chosen[0]]], U64) * U64(3) + np.array([mers[chosen[1]]], U64)
        out += f"{int(mixed(pair)[0]) >> 48:04x}"
    return out


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(d, t, l, s) for d, t, l, s in ROWS if d not in (None, 10, 7, 8)] + [
        (30 + i, " ".join(rng.choice(["aa", "bb", "ccc", "d" * 40]) for _ in range(rng.randrange(40))), "en", "a") for i in range(30)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, rows)).collect()}
    ordered = sorted(((d, t or "") for d, t, *_ in rows), reverse=True)
    assert len(got) == len(rows)
    for (doc_id, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1]):
        row, half = got[doc_id], len(text) // 2
        changed = text[:len(text) - half] + other[:half]
        marks = [brute_marks(t) for t in (text, changed, other)]
        assert (row["n_chars"], row["fingerprint"], row["edited_fingerprint"]) == (len(text), *marks[:2])
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for name, mark in (("near_edited", marks[1]), ("near_next", marks[2])):
            same = float(marks[0] == mark) if not (marks[0] and mark) else np.mean(
                [marks[0][4 * i:4 * i + 4] == mark[4 * i:4 * i + 4] for i in range(64)])
            assert row[name] == same


def test_fingerprints_follow_order_and_edits():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    close, moved, other = list(words), words[150:] + words[:150], [f"v{i}" for i in range(300)]
    close[7] = "changed"
    rng.shuffle(shuffled := list(words))
    marks = fingerprints.signatures(pa.array([" ".join(x) for x in (words, close, moved, other, shuffled)]))
    like = [(marks[0] == m).mean() for m in marks]
    assert like[0] == 1 and like[1] > 0.9 and like[3] == 0 and like[4] < 0.1 and like[4] < like[2] < like[1]


def test_fingerprints_awkward_rows(spark):
    got = fingerprints.fingerprints(documents(spark)).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(d) for d, *_ in ROWS)
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    (single,) = fingerprints.fingerprints(documents(spark, [(5, "one two three four", "en", "a")])).collect()
    assert single["near_next"] == 1.0


def test_repeats_against_plain_version(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(10))
    rows = []
    for i in range(60):
        lines = [" ".join(sentence() for _ in range(4)) for _ in range(4)]
        if i % 3 == 0:
            lines[1] += " " + passage + " " + sentence()
        rows.append((i, "\n".join(lines), "en", "a"))
    rows += [(70, rows[0][1], "en", "a"), (71, None, "en", "a")]
    got = {r["doc_id"]: r for r in repeats.drop_repeats(documents(spark, rows)).collect()}
    seen = set()
    for doc_id, text, *_ in rows:
        known = set()
        for a, b in repeats.units(text or ""):
            key = " ".join(text[a:b].lower().split())
            if key in seen:
                known.add((a, repeats.digest(text[a:b])[0]))
            seen.add(key)
        _, spans = repeats.removed_runs(text or "", known, repeats.MIN_RUN_WORDS)
        assert got[doc_id]["text"] == repeats.without(text or "", spans)
        assert got[doc_id]["removed"] == ",".join(f"{a}:{b}" for a, b in spans)
    assert passage in got[0]["text"] and all(passage not in got[i]["text"] for i in range(3, 60, 3))
    assert all(not got[i]["removed"] for i in range(60) if i % 3) and got[70]["text"].strip() == ""


def test_repeated_lines_and_paragraphs_of_few_words(spark):
    rows = [(1, "Home About\nOne text. Read more.\n\nAll rights\nreserved here.", "en", "a"),
            (2, "  home  about \nAnother text. Read more.\nRead more.\n\nAll rights reserved\nhere.", "en", "a"),
            (3, "New words. Home About\nRead more.\n\nHome About\nnew words again\nHome About", "en", "a")]
    got = {r["doc_id"]: r for r in repeats.drop_repeats(documents(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed"] == ""
    # The first whole line "Read more." stays: those before it stood inside lines.
    assert got[2]["text"] == "   \nAnother text. Read more.\nRead more.\n\n"
    assert got[3]["text"] == "New words. Home About\n\nnew words again\n"
    assert all(r["n_removed_chars"] == len(rows[d - 1][1]) - len(r["text"]) for d, r in got.items())


def test_repeats_awkward_rows(spark):
    got = repeats.drop_repeats(documents(spark)).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(d) for d, *_ in ROWS)
    assert len({r["text"] for r in got if r["doc_id"] == 10}) == 1
    assert repeats.drop_repeats(empty(spark)).count() == 0


WORDS = {"en": "the and of that with this from have they were".split(), "fr": "le la des une dans avec pour être sont était".split(),
         "de": "der die das und mit nicht über für ein wurde".split(), "es": "el los las una con para está señor niño qué".split()}


def language_rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[x]) for _ in range(rng.randrange(5, 60))), x, "a")
            for i, x in enumerate(rng.choice(sorted(WORDS)) for _ in range(n))]


def test_language_id_on_held_out_rows(spark):
    rows = language_rows(600, 1)
    docs = documents(spark, rows)
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.identify(docs, model).select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("out"), "lang_pred", "score").collect()
    true = {d: x for d, _, x, _ in rows}
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["out"]]
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_one_wrong_bit_is_corrected():
    codes = langid.codewords(4)
    model = langid.Model(["a", "b", "c", "d"], codes, np.zeros((1 << langid.BUCKET_BITS, codes.shape[1]), np.float32), np.ones(codes.shape[1]))
    for i, code in enumerate(codes):
        for bit in range(len(code)):
            wrong = code.astype(float).copy()
            wrong[bit] *= -1
            loss = np.exp(-np.clip(3 * wrong, -6, 6)[None, :] * model.codes).mean(axis=1)
            assert loss.argmin() == i
    many = langid.codewords(12)
    assert min((x != y).sum() for i, x in enumerate(many) for y in many[:i]) >= 15


def test_language_id_awkward_rows(spark):
    docs = documents(spark)
    model = langid.fit(docs, F.lit(True))
    got = langid.identify(docs, model).select("row.text", "lang_pred", "score", "ambiguous").collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    kept = langid.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.filter("text IS NULL").count() == 0
    assert langid.identify(empty(spark), model).count() == 0
    nothing = langid.fit(empty(spark), F.lit(True))
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    alone = langid.fit(documents(spark, [(1, "abc def", "xx", "a")]), F.lit(True))
    assert langid.decide(alone, ["hello", "1", "\u00b2 \u00bd \u2460", "x\u00b2"])[0] == ["xx", "und", "und", "xx"]
    repeated = langid.fit(documents(spark, [(1, "abc def", "xx", "a")] * 50 + [(2, "uvw xyz", "yy", "a")]), F.lit(True))
    assert repeated.languages == ["xx", "yy"]
    many = [(i, f"text {i}", f"l{i}", "a") for i in range(langid.MAX_LANGUAGES + 1)]
    with pytest.raises(ValueError):
        langid.fit(documents(spark, many), F.lit(True))
