"""Line dedup, decontamination, suffix dedup, Jaccard join and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import regex

import corpus_pipeline
import corpus_helpers as H
from mercato.llm import decontaminate, fingerprint, fm_index, graph, jaccard, line_dedup, suffix_dedup


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def empty(spark):
    return H.documents(spark, []).limit(0)


# --- line dedup

WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LETTERS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Yi}\p{Javanese}]"
SIGNS = r"[0-9\u3001-\u3004\u3008-\u3020\u30FB\u30FC\uFF01-\uFF65\u2018-\u201D\u2026]{0,8}"


def is_long(line):
    """Eight words parted by white space, or 24 letters of a script without spaces."""
    return (sum(w != "" for w in regex.split(WHITE, line)) >= 8
            or regex.search(f"(?:{LETTERS}{SIGNS}){{24}}", line) is not None)


def brute_lines(rows):
    """(doc_id, text) distinct -> text without later repeats; earlier by (doc_id, line)."""
    def items(t):
        return [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    seen, gone = {}, {}
    starts = []
    for i, t in rows:
        it = items(t)
        for a in range(len(it)):
            if a + 1 < len(it):
                starts.append(((it[a][1], it[a + 1][1]), (i, t, a), [it[a][0], it[a + 1][0]]))
            if is_long(it[a][1]):
                starts.append(((it[a][1],), (i, t, a), [it[a][0]]))
    for key, (i, t, a), _ in starts:
        order = (-1 if i is None else i, a)
        seen[key] = min(seen.get(key, order), order)
    for key, (i, t, a), nos in starts:
        if (-1 if i is None else i, a) > seen[key]:
            gone.setdefault((i, t), set()).update(nos)
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in rows}


def test_line_dedup_matches_brute_force(spark):
    docs = H.unique_documents(spark)
    want = brute_lines([(r["doc_id"], r["text"]) for r in rows_of(docs) if r["text"] is not None])
    got = line_dedup.dedup_lines(docs, report=True)
    assert got.columns[:len(docs.columns)] == docs.columns
    source = {r["doc_id"]: r["text"] for r in rows_of(docs)}
    for r in rows_of(got):
        t = source[r["doc_id"]]
        assert r["text"] == (want[(r["doc_id"], t)] if t is not None else None)
        if t is not None:
            assert r["n_chars"] == len(r["text"])


def test_line_dedup_edges(spark):
    docs = H.documents(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    ten = {r["doc_id"]: r["text"] for r in rows_of(got)}[16]
    assert ten.count("same line") == 1
    kept = line_dedup.dedup_lines(docs, drop_emptied=True)
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert {0, 1, 2, 3} <= set(ids) and 7 not in ids      # blank ones stay, a copy goes


def test_line_dedup_of_many_lines(spark):
    """Lines are walked once: 40,000 removed lines, with others and blank ones between them."""
    long = "\n".join(["same line"] * 20_000 + [x for k in range(10_000) for x in (f"line {k}", "")] + ["same line"] * 20_000)
    docs = spark.createDataFrame([(1, long), (2, "a\nb\nc\n\na\nb\nd\na\nb"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(line_dedup.dedup_lines(docs, report=True))}
    assert got[1]["n_removed"] == 39_999 and got[1]["n_runs"] == 2 and got[1]["n_lines"] == 50_000
    assert got[1]["text"] == "\n".join(["same line"] + [x for k in range(10_000) for x in (f"line {k}", "")])
    assert (got[2]["text"], got[2]["n_removed"], got[2]["n_runs"]) == ("a\nb\nc\n\nd", 4, 2)
    assert (got[3]["text"], got[3]["n_lines"], got[4]["text"], got[4]["n_lines"]) == (None, 0, "", 0)


def test_lines_are_told_by_white_space(spark):
    tabs, thai, han = "a\tb\tc\td\te\tf\tg\th", "สวัสดีชาวโลกทุกคนในวันนี้ที่นี่", "我们在这个城市里住了很多年，每天早上都去河边散步，看看水。"
    wide, few, gap = "a\u00a0b\u2003c d e f g h", "Total        12", "a \t b  c d e f g"
    rows = []
    for k, line in enumerate((tabs, thai, han, wide, few, gap)):
        rows += [(10 * k + j, f"before {k} {j}\n{line}\nafter {k} {j}") for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows_of(corpus_pipeline.drop_repeated_lines(spark, docs, ""))}
    assert all(got[i] == t for i, t in rows if i % 10 == 0 or i // 10 in (4, 5))
    assert [got[10 * k + 1] for k in range(4)] == [f"before {k} 1\nafter {k} 1" for k in range(4)]


# --- decontamination

def brute_hits(text, items, size=10):
    w = H.words(text)
    hit, found = set(), set()
    for name, t in items:
        v = H.words(t)
        n = min(size, len(v))
        windows = {tuple(v[k:k + n]) for k in range(max(0, len(v) - n + 1))} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in windows:
                found.add(name)
                hit.update(range(k, k + n))
    return len(w), len(hit), sorted(found), sorted(hit)


def benchmark(spark):
    base = H.prose(1, 300).split(" ")
    rows = [(1, " ".join(base[40:70])), (2, " ".join(base[60:75]).upper()), (10, "one two"), (3, None), (4, "..."), (5, "été ÜBER"),
            (6, H.prose(6, 4000)[5000:5400]), (7, " ".join(base[40:70]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_matches_brute_force(spark):
    items, bench = benchmark(spark)
    docs = H.documents(spark)
    marked = rows_of(decontaminate.mark_benchmark(docs, bench))
    assert len(marked) == docs.count()
    some = 0
    for r in marked:
        n, hit, found, _ = brute_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["item_ids"] == sorted(map(str, found))
        some += hit
    assert some > 0
    clean = decontaminate.remove_spans(docs, bench)
    assert clean.columns == docs.columns
    for r in rows_of(clean):
        # what was there is gone; a new neighbourhood may join words, so only single items are asked
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert decontaminate.remove_spans(empty(spark), bench).count() == 0
    none = bench.limit(0)
    assert {r["n_hit"] for r in rows_of(decontaminate.mark_benchmark(docs, none))} == {0}


def test_decontamination_in_packs(spark):
    items, bench = benchmark(spark)
    docs = H.documents(spark).select("doc_id", "text")
    packs = decontaminate.phrase_packs(bench, pack_bytes=300)
    assert len(packs) > 1
    from mercato.llm.textbytes import chunks
    import pyarrow as pa
    every = [t for t in H.texts()]
    for part in chunks(pa.array(every, pa.string())):
        for text, row in zip(every, decontaminate.judge(part, [p.value for p in packs]), strict=True):
            n, hit, found, _ = brute_hits(text, items)
            assert row[:3] == (n, hit, len(found))
    assert docs.count()


def test_fm_index():
    rng = np.random.default_rng(3)
    for n, symbols in ((1, 2), (50, 2), (700, 5), (3000, 40)):
        text = rng.integers(1, symbols + 1, n)
        index = fm_index.FMIndex(text, symbols)
        for size in (1, 2, 4):
            asked = rng.integers(1, symbols + 1, (40, size))
            low, high = index.search(asked)
            for p, a, b in zip(asked, low, high, strict=True):
                want = [k for k in range(n - size + 1) if (text[k:k + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- Jaccard join

def brute_components(rows, percent=90):
    sets = [(i, H.shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("tile", [jaccard.TILE, 250])
def test_jaccard_matches_brute_force(spark, tile):
    docs = H.documents(spark)
    want = brute_components([(r["doc_id"], r["text"]) for r in rows_of(docs)])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs, tile=tile)))
    assert got == want


def test_jaccard_chains_and_sizes(spark):
    """Chains of links, sets at the very bound, sizes 1 to 60."""
    rng = random.Random(5)
    rows, i = [], 0
    for n in (3, 8, 11, 12, 13, 21, 22, 40, 62, 200):
        w = [f"w{n}_{k}" for k in range(n)]
        for step in range(4):
            rows.append((i, " ".join(w)))
            i += 1
            w[-1 - step % n] = f"z{rng.randrange(10 ** 6)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (jaccard.TILE, 60):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs, tile=tile)))
        assert got == brute_components(rows)


def test_jaccard_signatures_keep_linked_pairs():
    rng = np.random.default_rng(1)
    for n in (9, 10, 19, 20, 55, 300, 2000):
        for _ in range(30):
            base = np.unique(rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64) * np.uint64(2))[:n]
            most = jaccard.max_difference(n)
            drop = int(rng.integers(0, most + 1))
            other = np.sort(np.concatenate([base[rng.permutation(n)[drop:]], rng.integers(0, 2 ** 63, most - drop).astype(np.uint64)]))
            if jaccard._linked(base, other, 90):
                assert np.intersect1d(jaccard.signatures(base), jaccard.signatures(other)).size


def test_jaccard_edges(spark):
    assert jaccard.join(empty(spark)).count() == 0
    docs = H.documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in rows_of(kept))
    assert ids[6] == 1 and ids[7] == 0 and ids[0] == 1 and ids[None] == 1


def shingles_of(text, size):
    w = H.re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(H.DOWN))
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_rows():
    """Texts and copies with words replaced: links at 0.8 on five words that 0.9 on three has not, and links past both."""
    rng, rows = random.Random(12), []
    for n in (6, 8, 14, 30, 100, 300, 1000):
        base = [f"w{n}_{k}" for k in range(n)]
        rows.append(" ".join(base))
        for share in (.01, .02, .025, .05):
            w, many = list(base), max(1, round(n * share))
            for j in range(many):
                w[(2 * j + 1) * n // (2 * many)] = f"z{rng.randrange(10 ** 9)}"
            rows.append(" ".join(w))
        rows.append(" ".join(base[:n - n // 6]))
    return list(enumerate(rows)) + [(500, None), (501, ""), (502, "a b")]


@pytest.mark.parametrize("tile", [jaccard.TILE, 250])
def test_jaccard_five_words_and_four_fifths(spark, tile):
    rows = near_rows() + [(1000 + i, t) for i, t in enumerate(H.texts())]
    sets = [shingles_of(t, 5) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    want = Counter((i, len(s), least[root[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs, 5, 80, tile)))
    assert got == want


def test_jaccard_signatures_keep_pairs_linked_by_four_fifths():
    rng = np.random.default_rng(2)
    for n in (4, 5, 8, 9, 20, 55, 300, 2000):
        for _ in range(30):
            base = np.unique(rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64) * np.uint64(2))[:n]
            most = jaccard.max_difference(n, 80)
            drop = int(rng.integers(0, most + 1))
            other = np.sort(np.concatenate([base[rng.permutation(n)[drop:]], rng.integers(0, 2 ** 63, most - drop).astype(np.uint64)]))
            if jaccard._linked(base, other, 80):
                assert np.intersect1d(jaccard.signatures(base, 80), jaccard.signatures(other, 80)).size


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_unlike_sets_share_no_signature(percent):
    """A part that is empty in many large sets is no candidate."""
    rng = np.random.default_rng(3)
    for parts in (4, 6, 9, 141, 316, 711):
        d = jaccard.most_difference(parts)
        assert d + 1 + jaccard.spare(d) <= parts < d + 2 + jaccard.spare(d + 1)
    signs = [jaccard.signatures(np.unique(rng.integers(0, 2 ** 63, 1000).astype(np.uint64) * np.uint64(2)), percent) for _ in range(60)]
    assert len(np.unique(np.concatenate(signs))) == sum(map(len, signs))


def test_pipeline_stage_takes_five_words_and_four_fifths(spark):
    """Two of 100 words replaced: 0.811 on five-word shingles, 0.885 on three."""
    w = [f"w{k}" for k in range(100)]
    near = [("x" if k in (33, 66) else x) for k, x in enumerate(w)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, "some other text of a few words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, ""))) == [1, 3]
    assert sorted(r["doc_id"] for r in rows_of(jaccard.keep_one(docs))) == [1, 2, 3]


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- suffix dedup

def brute_bytes(rows, span=50):
    least = {}
    for i, t in rows:
        b, i = (t or "").encode(), -1 if i is None else i
        for k in range(len(b) - span + 1):
            w = b[k:k + span]
            least[w] = min(least.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b, o = (t or "").encode(), -1 if i is None else i
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if least[b[k:k + span]] < o:
                gone[k:k + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int(np.diff(np.concatenate([[0], gone.astype(int), [0]])).clip(0).sum())
        out[(i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "range_bytes": 4000}, {"shard_bytes": 5000, "hot": 2}])
def test_suffix_dedup_matches_brute_force(spark, sizes):
    docs = H.documents(spark)
    want = brute_bytes([(r["doc_id"], r["text"]) for r in rows_of(docs)])
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(tuple(r[n] for n in names) for r in rows_of(suffix_dedup.dedup(docs, **sizes)))
    assert got == want
    assert sum(k[2] for k in want) > 0


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(4)
    for runs in (1, 2, 3, 7):
        rights, merged = [], []
        for _ in range(runs):
            n = int(rng.integers(0, 40))
            text = rng.integers(97, 99, (n, 12)).astype(np.uint8)
            text = text[np.lexsort(text.T[::-1])] if n else text
            shared, rest = suffix_dedup.front_code(text) if n else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
            assert (suffix_dedup.front_decode(shared, rest, 12) == text).all()
            rights.append(([int.from_bytes(x.tobytes(), "big") for x in text], shared.tolist()))
            merged += [x.tobytes() for x in text]
        order, shared = suffix_dedup.loser_tree(rights, 12)
        nth = [0] * len(rights)
        out = []
        for r in order:
            out.append(rights[r][0][nth[r]].to_bytes(12, "big"))
            nth[r] += 1
        assert out == sorted(merged)
        for k in range(1, len(out)):
            same = next((j for j in range(12) if out[k][j] != out[k - 1][j]), 12)
            assert shared[k] == same


# --- fingerprints

def test_fingerprints_match_brute_force(spark):
    docs = H.unique_documents(spark)
    rows = sorted((r["doc_id"], r["text"] or "") for r in rows_of(docs))
    for ranges in (1, 5):
        got = {r["doc_id"]: r for r in rows_of(fingerprint.fingerprints(docs, ranges))}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            q = len(t) // 4
            edited = t[:len(t) - q] + following[:q]
            r = got[i]
            mark = lambda s: fingerprint.fingerprint(fingerprint.code_points(s))
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (r["fingerprint"], r["edited_fingerprint"]) == (mark(t), mark(edited))
            assert r["near_edited"] == fingerprint.likeness(mark(t), mark(edited))
            assert r["near_next"] == fingerprint.likeness(mark(t), mark(following))
    assert fingerprint.likeness(mark(rows[6][1]), mark(rows[6][1])) == 1.0


def test_fingerprint_edges(spark):
    docs = H.documents(spark)
    assert fingerprint.fingerprints(docs).count() == docs.count()
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    one = rows_of(fingerprint.fingerprints(H.documents(spark, [(5, "abcdefgh")])))[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def test_prefix_hash_extensions():
    a, b = (fingerprint.PrefixHash(fingerprint.code_points(t)) for t in ("xx common part yy", "common part zz"))
    assert a.common_extension(3, b, 0) == len("common part ")
    assert a.equal(3, b, 0, 6) and not a.equal(2, b, 0, 6)
