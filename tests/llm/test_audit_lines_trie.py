"""Filter audit, line dedup and the conversation trie against plain Python versions on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import ROWS, documents, empty
from webloom.llm import filter_audit, line_dedup, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows):
    """Failing filters per row, written from the contract."""
    texts = [(d, t or "") for d, t, *_ in rows]
    out = []
    for d, t in texts:
        words = WORD.findall(t)
        bits = 0
        bits |= 1 if len(words) < 200 else 0
        bits |= 2 if 100 * len(set(words)) < 50 * len(words) else 0
        bits |= 4 if 100 * sum("A" <= ch <= "Z" for ch in t) > 2 * len(t) else 0
        bits |= 8 if any(ch in "#$%&*|" for ch in t) else 0
        smaller = [e for e, u in texts if u == t and e is not None and (d is None or e < d)]
        bits |= 16 if smaller else 0
        out.append(bits)
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    fails = plain_fails(rows)
    by_part = defaultdict(list)
    for (d, _, _, source), f in zip(rows, fails):
        by_part[source or ""].append((d, f))
    out = set()
    for part, docs in by_part.items():
        for order in permutations("ABCDE"):
            for step in range(5):
                bit = 1 << "ABCDE".index(order[step])
                before = sum(1 << "ABCDE".index(c) for c in order[:step])
                gone = [(d, f) for d, f in docs if f & bit and not f & before]
                shapley = 0
                for other in permutations("ABCDE"):
                    prior = sum(1 << "ABCDE".index(c) for c in other[:other.index(order[step])])
                    shapley += sum(1 for _, f in docs if f & bit and not f & prior)
                out.add((part, "".join(order), step + 1, sum(1 for _, f in docs if not f & (bit | before)), len(gone),
                         sum(1 for _, f in docs if f & bit and f & before), sum(1 for _, f in docs if f == bit),
                         sum(1 for d, _ in gone if d in good), sum(1 for d, _ in gone if d in toxic), shapley))
    return out


AUDIT_ROWS = ROWS + [
    (20, " ".join(f"w{i}" for i in range(250)), "en", "a"), (21, " ".join(f"w{i}" for i in range(250)), "en", "a"),
    (22, "AB " * 300, "en", "b"), (23, "price $5 " + " ".join(f"v{i}" for i in range(220)), "en", None),
    (None, " ".join(f"w{i}" for i in range(250)), "en", "a"), (24, "x", "en", "a"), (24, "x", "en", "a"),
]
LABELS = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (9, 1, 1), (None, 1, 1), (24, 0, 1)]


def test_filter_audit(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, AUDIT_ROWS), labels).drop("filter").collect()
    assert len(got) == 600 * len({(s or "") for *_, s in AUDIT_ROWS})
    assert {tuple(r) for r in got} == plain_audit(AUDIT_ROWS, LABELS)
    assert filter_audit.audit(empty(spark), labels).count() == 0


def test_gallop_merge():
    import numpy as np
    lists = [np.array([1, 2, 3, 4, 5, 9, 20]), np.array([5, 6, 20]), np.array([], dtype=np.int64), np.array([30])]
    want = Counter()
    for i in {x for ids in lists for x in ids}:
        want[sum(1 << k for k, ids in enumerate(lists) if i in set(ids))] += 1
    assert filter_audit.merge_counts(lists) == dict(want)


def plain_lines(rows, min_docs):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                                                               "abcdefghijklmnopqrstuvwxyz"))
    docs = Counter()
    for _, t, *_ in rows:
        docs.update({key(x) for x in (t or "").split("\n") if key(x)})
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < min_docs or not key(x)]
        out[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


LINE_ROWS = ROWS + [
    (30, "Menu\nHome | About\nreal text one", "en", "a"), (31, "  menu \t\nother\nHome | About", "en", "a"),
    (32, "MENU\n\n\nlast", "en", "b"), (33, "menü\nmenu", "en", "b"), (34, "\n".join(["menu"] * 5), "en", "b"),
]


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_line_dedup(spark, min_docs):
    got = line_dedup.line_dedup(documents(spark, LINE_ROWS), min_docs=min_docs).select(
        "row.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == plain_lines(LINE_ROWS, min_docs)


def test_line_dedup_edges(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    frequent = [(i, f"header\nbody {i}\nfooter line", "en", "a") for i in range(400)]
    got = line_dedup.line_dedup(documents(spark, frequent)).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == plain_lines(frequent, 10)
    assert {r["n_dropped"] for r in got} == {2}


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t if t is not None else 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + turns[zlib.crc32(str(c).encode()) % 9:]
               for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = set()
    for p, ms in members.items():
        sub = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in ms if len(rebuilt[c]) == len(p))
        out.add((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]),
                 sum(1 for q in sub if not children[q]), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q),
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def trie_rows():
    rows = []
    for c in range(0, 40):
        for t in range(c % 11):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}" if t < 6 else f"own {c} {t}"))
    rows += [(40, None, None, None), (40, 0, "user", "é" * 3), (40, 0, "user", "a"), (41, 2, "user", None),
             (42, 1, "user", "same"), (42, 1, "user", "same"), (None, 1, "user", "lost"), (-7, 0, "user", "</s>"),
             (-7, 1, "assistant", "[INST]"), (45, 0, "user", "x" * 5000), (46, 0, "user", "x" * 5000)]
    return rows


def test_prefix_trie(spark):
    rows = trie_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = table.select("*", *[F.lit(1).alias(c) for c in ("key", "depth", "n_convs", "rep", "cur", "prev", "j")])
    got = {tuple(r) for r in prefix_trie.prefix_trie(clash).drop("key").collect()}
    assert got == plain_trie(rows)
    assert prefix_trie.prefix_trie(table.filter("false")).count() == 0


def test_prefix_trie_uniform_and_divergent_blocks(spark):
    """Long shared blocks (one chain of nodes) and blocks where siblings part inside."""
    rows = []
    for c in range(60):
        n = 9 + c % 7
        for t in range(n):
            text = "shared" if t < 8 or c % 2 else f"apart {c % 4}"
            rows.append((c * 5, t, "user", text))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie.prefix_trie(table).drop("key").collect()} == plain_trie(rows)
