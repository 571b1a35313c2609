"""The training-data operators against brute force, and on nulls, ties, repeats, empty and odd tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import exact, media, minhash, mixing, packing, pii, quality, sharding, substring, toxicity
from strandlake.llm import queries as Q
from strandlake.llm.common import slices
from strandlake.llm.labelled import held_out

SCHEMA = "doc_id long, text string, source string, size long, kept string, row long, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Passages, copies, near copies, nulls, empties, ties and one very long text."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(r.randint(0, 90))]
        kind = i % 6
        if kind == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        elif kind == 1:
            words = list(base)
            for _ in range(r.randint(0, 9)):
                words[r.randrange(len(words))] = word()
        elif kind == 2:
            words = base[:50] if i % 4 else ["One", "two,", "three"]
        rows.append((i, " ".join(words), f"s{i % 3}"))
    rows += [(200, None, None), (201, "", "s1"), (202, " \n\t ", None), (203, "Ünï code é\x1c", "s0"), (204, " ".join(word() for _ in range(30000)), "s0"), (205, rows[1][1].upper(), "s2"), (206, None, "s2"), (0, rows[0][1], "s0"), (None, "no id", "s1")]
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, corpus):
    got = exact.exact_groups(table(spark, corpus)).collect()
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[t or ""].append(-1 if i is None else i)
    want = Counter((i, max(groups[t or ""]) if max(groups[t or ""]) >= 0 else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in corpus)
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    assert sum(x.kept for x in got) == len(groups)  # of repeated rows one stays
    kept = exact.drop_copies(table(spark, corpus))
    assert kept.columns == table(spark, corpus).columns and kept.count() == len(groups)
    assert exact.exact_groups(empty(spark)).count() == 0


def test_exact_flushes_pages(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact, "PAGE_BYTES", 2000)
    assert exact.exact_groups(table(spark, corpus * 3).coalesce(2)).filter("kept").count() == len({t or "" for _, t, _ in corpus})


def test_exact_directory_doubles(spark, corpus, monkeypatch):
    """Prefixes of 1 bit are overfull and are counted by longer ones; the groups stay the same."""
    want = Counter(exact.exact_groups(table(spark, corpus)).drop("kept").collect())
    monkeypatch.setattr(exact, "FIRST_DEPTH", 1)
    monkeypatch.setattr(exact, "DEEPEST", 7)
    monkeypatch.setattr(exact, "BUCKET_BYTES", 3000)
    assert Counter(exact.exact_groups(table(spark, corpus)).drop("kept").collect()) == want
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 300)
    entries = spark.createDataFrame([(int(k), b"x" * 36) for k in keys], "key long, bytes binary")
    sizes = exact.prefix_sizes(entries, 1, 9, 1000)
    assert sizes.sum() == 300 * 100 and len(sizes) <= 1 << 9 and sizes.max() <= 1000
    exactly = np.bincount((keys.view(np.uint64) >> np.uint64(64 - 9)).astype(int), minlength=1 << 9) * 100
    assert all(a <= b for a, b in zip(np.cumsum(exactly), np.cumsum(sizes)))


def test_directory():
    sizes = np.array([5, 1, 1, 1, 90, 0, 1, 1])
    firsts, depths, depth = exact.build_directory(sizes, 10)
    assert firsts.tolist() == [0, 4, 5, 6] and depths.tolist() == [1, 3, 3, 2] and depth == 3
    assert exact.assign_owners(sizes, firsts, 2).tolist() == sorted(exact.assign_owners(sizes, firsts, 2).tolist())


def brute_minimax(sizes, shards):
    best = [[0] + [10**9] * len(sizes)]
    for _ in range(shards):
        last = best[-1]
        best.append([0] + [min(max(last[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(1, len(sizes) + 1)])
    return best[-1][-1]


def test_minimax_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.choice([0, 1, 5, 40]) for _ in range(r.randint(1, 12))]
        cuts = sharding.minimax_cuts(np.array(sizes), 4).tolist()
        parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)])]
        assert cuts == sorted(cuts) and max(parts) == brute_minimax(sizes, 4)


def test_refined_cells_against_dynamic_programming():
    """Cells of groups, divided only where cuts may fall, give the capacity over all groups."""
    r = random.Random(2)
    for _ in range(60):
        groups = sorted({r.randrange(-(1 << 63), 1 << 63): r.choice([1, 5, 40, 300]) for _ in range(r.randint(1, 14))}.items())

        def counted(depth, inside=lambda h: True):
            held = defaultdict(list)
            for h, n in groups:
                if inside(h):
                    held[h >> (64 - depth)].append(n)
            return sharding.Cells([c << (64 - depth) for c in held], [depth] * len(held), [sum(v) for v in held.values()], [len(v) == 1 for v in held.values()])

        def divide(cells, index):
            parts = [counted(int(cells.depth[i]) + 1, lambda h, i=i: h >> (64 - int(cells.depth[i])) == int(cells.start[i]) >> (64 - int(cells.depth[i]))) for i in index]
            return sharding.Cells(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("start", "depth", "size", "single")))

        cells = sharding.refined(counted(2), 4, divide)
        cuts = sharding.minimax_cuts(cells.size, 4).tolist()
        parts = [cells.size[a:b].sum() for a, b in zip([0, *cuts], [*cuts, len(cells.size)])]
        assert max(parts) == brute_minimax([n for _, n in groups], 4)


@pytest.mark.parametrize("bits", [2, 16])
def test_sharding_reaches_the_smallest_capacity(spark, corpus, bits):
    got = sharding.shard(table(spark, corpus), 5, cell_bits=bits).join(table(spark, corpus).selectExpr("doc_id AS i", "coalesce(text, '') AS t").distinct(), F.col("doc_id").eqNullSafe(F.col("i")))
    rows = got.selectExpr("xxhash64(t) AS h", "size", "shard").collect()
    groups, load = Counter(), Counter()
    for x in rows:
        groups[x.h] += x["size"]
        load[x.shard] += x["size"]
    assert len(rows) == len(corpus) and max(load.values()) == brute_minimax([groups[h] for h in sorted(groups)], 5)
    by_hash = sorted((x.h, x.shard) for x in rows)
    assert [s for _, s in by_hash] == sorted(s for _, s in by_hash)


def test_sharding(spark, corpus):
    got = sharding.shard(table(spark, corpus), 5).collect()
    by_text, by_shard = defaultdict(set), defaultdict(list)
    texts = {i: t or "" for i, t, _ in corpus}
    for x in got:
        assert x["size"] == len(texts[x.doc_id].encode()) + 8 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) and x.law == "bytes"
        by_text[texts[x.doc_id]].add(x.shard)
        by_shard[x.shard].append(x.slot)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len(got) == len(corpus) and sharding.shard(empty(spark), 5).count() == 0


def test_pii_base_patterns():
    text = "é a.b+c@x-y.co.uk, 10.1.255.0 300.1.1.1, 4111 1111-1111 1111, +44 (0)20 7946 0958, 12@no +1 2,  1.2.3.4.5 a@b.c@d.e"
    spans = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", "a.b+c@x-y.co.uk"), ("email", "a@b.c"), ("ip", "10.1.255.0"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+44 (0)20 7946 0958")]


def test_pii_emails_against_the_pattern():
    r = random.Random(3)
    for _ in range(20000):
        s = "".join(r.choice("ab1@@..-_%+ (é)9") for _ in range(r.randint(0, 25)))
        assert [m.span() for m in pii._emails(s)] == [m.span() for m in pii._EMAIL.finditer(s)]


def brute_spans(text):
    """The contract's patterns as they stand, filtered by their conditions."""
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: max(map(int, s.split("."))) <= 255),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (pattern, ok) in kinds.items() for m in re.finditer(pattern, text) if ok(m.group())]


def test_pii_kinds_against_the_patterns():
    r = random.Random(6)
    parts = ["1", "12", "255", "256", "0", "007", ".", ".", ".", "+", "+4", "-", " ", "(", ")", "4111111111111111", "5500 0000 0000 0004", "a@b.c", "é", "٣", "x", "1.2.3.4", "0123456789"]
    seen = Counter()
    for _ in range(20000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = brute_spans(s)
        assert pii.base_spans(s) == want
        seen.update(k for k, _, _ in want)
    assert min(seen[k] for k in pii.KINDS) > 100


def test_pii_is_linear():
    """Runs of a million digits, and 50,000 spans in one text."""
    for text in ("7" * 10**6 + ".", "7." + "7" * 10**6, "+1" + "(" * 10**6, "a@" + "b" * 10**6, "1-" * 10**6, "a" * 10**6 + "@", "x@y.z " * 50000):
        began = time.time()
        spans = pii.base_spans(text)
        pii.document_terms(text, spans)
        assert time.time() - began < 4
    assert len(spans) == 50000


def brute_terms(rows, disclosure=0.8, bits=3.0):
    """Spans of kind term by document from plain counts over whole tokens."""
    held, terms, words = {}, {}, {}
    for i, t, _ in rows:
        t = t or ""
        spans = brute_spans(t)
        held[i] = {(k, t[a:b]) for k, a, b in spans}
        words[i] = {m.group() for m in WORD.finditer(t)}
        terms[i] = [(m.group(), m.span()) for m in WORD.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
    with_word, with_entity = (Counter(x for v in d.values() for x in v) for d in (words, held))
    both = Counter((e, w) for i in held for e in held[i] for w in {w for w, _ in terms[i]})
    tells = set()
    for (e, w), n in both.items():
        p = n / (with_word[w] + 1)
        assert p <= 1
        if p >= disclosure - 1e-9 and np.log2(p) - np.log2(with_entity[e] / len(rows)) >= bits:
            tells.add((e, w))
    return {i: sorted(span for w, span in terms[i] if any((e, w) in tells for e in held[i])) for i in held}


def test_pii_terms_against_counts(spark):
    """Words that touch an entity, entities within words, terms of several entities."""
    r = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"w{r.randrange(60)}" for _ in range(r.randint(0, 25))]
        if i % 15 == 0:
            words += ["mail:foo@x.com,", "Quill", "Quill"]
        if i % 75 == 0:
            words += ["mail:"]
        if i % 20 == 1:
            words += ["10.1.2.3", "Brindle", "from:foo@x.com"] + (["foo@x.com"] if i % 40 == 1 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), "s"))
    want = brute_terms(rows)
    got = {x.doc_id: sorted((int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term") for x in pii.find_pii(table(spark, rows)).collect()}
    assert got == want and sum(map(len, want.values())) > 40


def test_pii_terms(spark, monkeypatch):
    rows = [(i, f"the clerk Zebulon of unit{i} wrote from boss@corp.example.com about item{i * 7}", "s") for i in range(8)]
    rows += [(100 + i, f"the plain number{i} of the wrote", "s") for i in range(200)] + [(400, None, "s"), (401, "", "s"), (8, "the clerk Zebulon alone", "s")]
    got = {x.doc_id: x for x in pii.find_pii(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    want = [("email", "boss@corp.example.com"), ("term", "clerk"), ("term", "Zebulon"), ("term", "about"), ("term", "from")]
    text = rows[3][1]
    found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in got[3].spans.split(","))]
    # 8 of 9 documents with the words hold the entity: 8 / 10 reaches the threshold; "of", "the", "wrote" do not
    assert sorted(found) == sorted(want) and got[3].n_email == 1
    assert got[100].spans == "" and got[8].spans == "" and got[400].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.sanitise(text, got[3].spans) == "the  <name> of unit3 wrote  <email>  item21"
    monkeypatch.setattr(pii, "BROADCAST_TERMS", -1)
    assert {x.doc_id: x.spans for x in pii.find_pii(table(spark, rows)).collect()} == {i: x.spans for i, x in got.items()}
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_terms_anywhere_in_the_document(spark):
    """A name far from the address, and again later in the text, is found in every document that holds both."""
    gap = " ".join(["the of and to in it is"] * 4)
    rows = [(i, f"Zebulon {gap} boss@corp.example.com {gap} unit{i} Zebulon", "s") for i in range(8)] + [(100 + i, gap, "s") for i in range(200)]
    got = {x.doc_id: x for x in pii.find_pii(table(spark, rows)).collect()}
    found = [rows[3][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[3].spans.split(",")) if k == "term"]
    assert found == ["Zebulon", "Zebulon"] and got[100].spans == ""
    assert "Zebulon" not in pii.sanitise(rows[3][1], got[3].spans)


def brute_near(rows, width, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    unique = [s for s in dict.fromkeys(s for _, s in sets) if s]
    label = list(range(len(unique)))
    for x in range(len(unique)):
        for y in range(x):
            a, b = unique[x], unique[y]
            if 100 * len(a & b) >= percent * len(a | b) and label[x] != label[y]:
                label = [label[y] if k == label[x] else k for k in label]
    at = {s: label[k] for k, s in enumerate(unique)}
    ids = defaultdict(list)
    for i, s in sets:
        if s and i is not None:
            ids[at[s]].append(i)
    return Counter((i, len(s), min(ids[at[s]], default=None) if s else i) for i, s in sets)


@pytest.mark.parametrize("width", [4, 5])
def test_minhash(spark, corpus, width):
    got = minhash.near_duplicates(table(spark, corpus), width=width).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_near(corpus, width, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_minhash_blocks_and_tiles(spark, monkeypatch):
    """A large loose group: most pairs near the threshold, lists in many blocks, tiles of few documents."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(90)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    monkeypatch.setattr(minhash, "BLOCK", 40)
    monkeypatch.setattr(minhash, "TILE", 20)
    monkeypatch.setattr(minhash, "FAN", 7)
    got = minhash.near_duplicates(table(spark, rows), width=4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_near(rows, 4, 80)


def test_minhash_recall_at_the_threshold(spark):
    """Pairs at 0.8 or just above, of 10 to 120 shingles, where lists and sketches are cut short."""
    r = random.Random(12)
    rows = []
    for i in range(400):
        n = r.randint(10, 120)
        words = [f"p{i}w{k}" for k in range(n + 3)]
        gone = n // 9  # n - gone of n + gone shingles are common
        at = r.choice(["end", "start"])
        fresh = [f"p{i}x{k}" for k in range(gone)]
        near = words[: len(words) - gone] + fresh if at == "end" else fresh + words[gone:]
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(near), "s")]
    got = minhash.near_duplicates(table(spark, rows), width=4).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i // 2 * 2 for i in range(800)}


def test_minhash_null_id_links(spark):
    """A chain 7 - null - 8 whose ends meet only through the row without an id."""
    words = [f"w{k}" for k in range(60)]
    chain = [(7, " ".join(words), "s"), (None, " ".join(words[4:]), "s"), (8, " ".join(words[8:]), "s")]
    got = {x.doc_id: x for x in minhash.near_duplicates(table(spark, chain), width=4).collect()}
    assert brute_near(chain, 4, 80) == Counter({(7, 57, 7): 1, (None, 53, 7): 1, (8, 49, 7): 1})
    assert {i: x.component_id for i, x in got.items()} == {7: 7, None: 7, 8: 7} and got[7].kept and not got[None].kept
    assert [x.doc_id for x in minhash.drop_near_copies(table(spark, chain), width=4).collect()] == [7]


def test_dropping_copies_where_ids_repeat(spark):
    """An id with two texts: a row goes or stays by its own text."""
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a, "s"), (9, a, "s"), (1, b, "s"), (1, b, "s"), (None, "", "s"), (None, None, "s")]
    got = exact.drop_copies(table(spark, rows)).collect()
    assert Counter((x.doc_id, x.text or "") for x in got) == Counter([(9, a), (1, b), (None, "")])
    near = [(5, a, "s"), (1, a + " more", "s"), (5, b, "s"), (5, b, "s"), (None, "", "s"), (None, None, "s"), (None, "x y z", "s")]
    got = minhash.drop_near_copies(table(spark, near)).collect()
    assert Counter((x.doc_id, x.text or "") for x in got) == Counter([(1, a + " more"), (5, b), (None, ""), (None, ""), (None, "x y z")])


def test_clashing_names(spark, corpus):
    """Columns named like the helpers' own."""
    names = ["__id", "__sha", "__n", "__nth", "__key", "__kept_key", "__kept_id", "__kept_sha", "__row", "__words", "__size", "__times", "__copy", "spans", "key", "id", "text_sha256"]
    plain = table(spark, corpus)
    docs = plain.select("*", *(F.lit(7).alias(n) for n in names))
    for f in (exact.drop_copies, minhash.drop_near_copies, mixing.mixed, pii.sanitised):
        out = f(docs)
        assert out.columns == docs.columns and Counter(r[:7] for r in out.collect()) == Counter(tuple(r) for r in f(plain).collect()), f


def test_minhash_empty(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("shape", [(7, 5), (7, 5, 3), (1, 1), (9, 64)])
def test_media_formats(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all()
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2)
    assert (media.decode(media.encode_bmp(image)) == rgb).all()
    wide = image.astype(np.uint16) * 257
    assert (media.decode(media.encode_netpbm(wide)) == wide).all()
    # area means by hand: every source pixel is cut in 6 x 6 parts
    big = np.repeat(np.repeat(image.astype(float), 6, 0), 6, 1)
    want = big.reshape(6, image.shape[0], 6, image.shape[1], *image.shape[2:]).mean((1, 3))
    assert np.allclose(media.area_resize(image, 6, 6), want)


def test_media_small_formats():
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n9\n3 9\n").tolist() == [[3, 9]] and media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P9\n1 1\n", b"P5\n4 4\n255\nxx", b"P5\n0 4\n255\n", b"BM", b"P2\n2 1\n9\n3\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def npy(array):
    import io

    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def brute_hash(grey):
    """Difference hash by weights of every source pixel in every target cell."""
    def weights(n, parts):
        edge = np.arange(parts + 1) * (n / parts)
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, 1)

    rows, columns = weights(grey.shape[0], 8), weights(grey.shape[1], 9)
    small = np.round(rows @ grey.astype(float) @ columns.T * 72 / grey.size, 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def test_resize_in_bands(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (301, 24, 3), dtype=np.uint8)
    whole = media.area_resize(image, 8, 9)
    monkeypatch.setattr(media, "BAND", 7)
    assert np.allclose(media.area_resize(image, 8, 9), whole)


def test_bitmap_masks():
    """Bit fields in another order than blue, green, red, and the 16-bit default."""
    import struct

    def bitmap(bits, packing, masks, pixels):
        raw = b"".join(struct.pack("<I" if bits == 32 else "<H", p) for p in pixels).ljust(-(-len(pixels) * bits // 32) * 4, b"\0")
        body = struct.pack("<III", *masks) if packing else b""
        return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(body)) + struct.pack("<IiiHHIIiiII", 40, len(pixels), 1, 1, bits, packing, 0, 0, 0, 0, 0) + body + raw

    assert media.decode(bitmap(32, 3, (0xFF, 0xFF00, 0xFF0000), [0x030201, 0xFFFFFF])).tolist() == [[[1, 2, 3], [255, 255, 255]]]
    assert media.decode(bitmap(16, 3, (0xF800, 0x7E0, 0x1F), [0xF800, 0x7E0, 0x1F])).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255]]]
    assert media.decode(bitmap(16, 0, (), [0x7C00])).tolist() == [[[255, 0, 0]]]
    with pytest.raises(ValueError):
        media.decode(bitmap(32, 3, (0b101, 0xFF00, 0xFF0000), [1]))


def test_text_media(spark, corpus):
    got = media.text_media(table(spark, corpus)).collect()
    texts = {i: (t or "").encode() for i, t, _ in corpus}
    seen = {}
    for x in got:
        t = texts[x.doc_id]
        p = t.ljust(max(576, -(-len(t) // 576) * 576), b"\xff")
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert hashlib.sha256(media.to_media(p)).hexdigest() == x.media_sha256 and seen.setdefault(t, x.feature) == x.feature
        grey = np.frombuffer(p, np.uint8).reshape(-1, 24)
        saved = b"".join(npy(grey[y : y + 64]) for y in range(0, len(grey), 64))
        assert x.feature == f"{brute_hash(grey)}:{-(-len(grey) // 64)}:{zlib.crc32(saved):08x}" and x.bmp_payload_crc32 == zlib.crc32(p)
    assert len(got) == len(corpus) and media.text_media(empty(spark)).count() == 0


def test_text_media_reaches_every_tile(spark):
    base = "a" * 5000
    got = media.text_media(table(spark, [(1, base, "s"), (2, base[:4900] + "b" + base[4901:], "s"), (3, "", "s")])).collect()
    mark = {x.doc_id: x.feature.split(":") for x in got}
    # 9 units of 576 bytes are 216 rows, so 4 tiles
    assert mark[1][1] == "4" and mark[3][1] == "1" and mark[1][2] != mark[2][2]
    image = media.decode(media.to_media(base.encode().ljust(5184, b"\xff")))
    assert mark[1][2] == f"{zlib.crc32(b''.join(t for _, _, t in media.tiles(image))):08x}"


def test_image_tiles(spark):
    import io

    image = np.arange(70 * 66, dtype=np.uint32).astype(np.uint8).reshape(70, 66)
    df = spark.createDataFrame([(1, media.encode_netpbm(image)), (2, None), (3, b"junk")], "doc_id long, data binary")
    got = media.image_tiles(df, "doc_id", "data").collect()
    back = np.zeros_like(image)
    for x in got:
        if x.error is None:
            t = np.load(io.BytesIO(x.npy))
            back[x.row * 64 : x.row * 64 + t.shape[0], x.col * 64 : x.col * 64 + t.shape[1]] = t
    assert (back == image).all() and sorted(x.doc_id for x in got if x.error) == [2, 3]


def test_gru_gradients():
    net, r = toxicity.Network(), np.random.default_rng(0)
    net.w = {k: v.astype(float) for k, v in net.w.items() if k not in ("ew", "ec")}
    x, length, y = r.normal(size=(9, toxicity.INPUTS)), np.array([12, 20, 7]), np.array([1, 0, 1.0])
    tokens = r.integers(0, 9, (3, toxicity.WINDOW))
    loss = lambda: (np.logaddexp(0, net.logits(x, tokens, length)) - y * net.logits(x, tokens, length)).sum()
    g = net.gradients(x, tokens, length, lambda out: 1 / (1 + np.exp(-out)) - y)
    for k, w in [*net.w.items(), *[("x", x)] * 5]:
        at = tuple(r.integers(0, s) for s in w.shape)
        old, e = w[at], 1e-3
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-3


def slices_of(texts):
    return list(slices([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]))


def test_words_and_grams():
    """Distinct words of a slice and their marked grams, against plain loops."""
    (piece,) = slices_of(["Ab, (cdefg) ab", "", "x é"])
    p = toxicity.Words(piece)
    plain = [b"ab", b"cdefg", b"ab", b"x", "é".encode()]
    assert len(p.words) == 4 and p.of.tolist()[0] == p.of.tolist()[2] and p.first.tolist() == [0, 3, 3, 5]
    for w, k in zip(plain, p.of):
        marked = b" " + w + b" "
        want = [marked[i : i + 4].ljust(4, b" ") for i in range(max(1, len(marked) - 3))]
        codes = toxicity._splitmix(np.array([int.from_bytes(x, "little") for x in want], np.uint64)) >> np.uint64(64 - toxicity.CHAR_BITS)
        assert p.grams[p.cuts[k] : p.cuts[k] + p.counts[k]].tolist() == codes.astype(int).tolist()


def test_recurrence_learns_order():
    """Both classes hold the same words; only their order tells the classes apart, which no count of words or grams does."""
    r = random.Random(7)
    texts, y = [], []
    for _ in range(1200):
        words = [f"w{r.randrange(200)}" for _ in range(r.randint(4, 12))]
        at = r.randrange(len(words))
        y.append(r.randrange(2))
        words[at:at] = ["grubby", "snork"] if y[-1] else ["snork", "grubby"]
        texts.append(" ".join(words))
    (train,), (test,) = slices_of(texts[:1000]), slices_of(texts[1000:])
    model = toxicity.fit([train], [np.array(y[:1000])], steps=1000)
    assert ((model.score(test) >= 0.5) == np.array(y[1000:])).mean() > 0.9


def test_windows_cover():
    first = np.array([0, 0, 3, 67, 67 + 200])
    start, length, doc = toxicity.windows(first)
    for d in range(4):
        covered = {k for s, n, o in zip(start, length, doc) if o == d for k in range(s, s + n)}
        assert covered == set(range(first[d], first[d + 1])) and (doc == d).any()


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(r.randint(10, 150))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubby", "snork", word()[:2] + "zzqxz" + word()[:2]]))
        good = i % 2
        if not good:
            words = [w + "!!" for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, good, int(toxic)))
    rows += [(2000, None, "s"), (2001, "", "s"), (None, "x", "s")]
    return table(spark, rows), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_toxicity_long_texts(spark, labelled):
    """Labelled texts over the budget come first in the order, or are all that a class has."""
    docs, labels, known = labelled
    texts = {x.doc_id: x.text for x in docs.collect()}
    ids = [i for i in known if i in texts and i is not None]
    first = toxicity.within_budget(pd.DataFrame({"id": [1, 2, 3, 4, 5], "y": [0, 0, 1, 1, 1], "b": [900, 10, 30, 500, 20], "k": [0, 1, 2, 3, 4]}), 120)
    assert sorted(first) == [2, 3, 5]
    alone = toxicity.within_budget(pd.DataFrame({"id": [1, 2, 3], "y": [0, 1, 1], "b": [10, 900, 800], "k": [0, 1, 2]}), 120)
    assert sorted(alone) == [1, 3] and toxicity.within_budget(pd.DataFrame({"id": [], "y": [], "b": [], "k": []}), 120) == []
    order = docs.selectExpr("doc_id", "xxhash64(13, doc_id) AS k").filter("doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    lead = [x.doc_id for x in order.orderBy("k", "doc_id").collect() if x.doc_id in ids][:3]
    most = sum(len((texts[i] or "").encode()) for i in ids)
    long = docs.selectExpr("doc_id", f"IF(doc_id IN ({','.join(map(str, lead))}), concat(text, repeat(' zz', {most})), text) AS text")
    model = toxicity.train(long, labels, most_bytes=most, steps=300)
    assert model.odds is not None
    got = toxicity.score_toxicity(docs.filter(~docs.doc_id.isin(lead)), model).collect()
    right = [x.predicted == known[x.doc_id][1] for x in got if x.held_out and x.doc_id in known]
    assert sum(right) > 0.9 * len(right)


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    out = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert np.mean([x.predicted == truth[x.doc_id][1] for x in out]) > 0.9
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert not any(x.predicted for x in got if x.doc_id in (2000, 2001))
    none = toxicity.score_toxicity(docs, toxicity.train(docs, labels.limit(0)))
    assert none.filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_toxicity_repeated_rows(spark, labelled):
    """Equal texts get one score; a repeated row or label changes neither the rows' number nor the fit's classes."""
    docs, labels, truth = labelled
    twice = docs.unionByName(docs.filter("doc_id < 40"))
    model = toxicity.train(twice, labels.unionByName(labels.filter("doc_id < 40")), steps=40)
    got = toxicity.score_toxicity(twice, model).collect()
    scores = defaultdict(set)
    for x in got:
        scores[x.doc_id].add(x.score)
    assert len(got) == twice.count() and all(max(v) - min(v) < 1e-4 for v in scores.values())


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    got = quality.score_quality(docs, quality.train(docs, labels)).collect()
    out = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id][0] for x in out]) > 0.95
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    none = quality.score_quality(docs, quality.train(docs, labels.limit(0)))
    assert none.filter("score <> 0.5").count() == 0


def test_quality_edges(spark, labelled):
    """An empty table, repeated rows, and equal texts under several ids."""
    docs, labels, _ = labelled
    model = quality.train(docs, labels)
    assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.score_quality(empty(spark), quality.train(empty(spark), labels)).count() == 0
    twice = docs.unionByName(docs.filter("doc_id < 30")).unionByName(docs.filter("doc_id < 30").selectExpr("doc_id + 9000 AS doc_id", "text", "source", "size", "kept", "row", "shard"))
    scores, rows = defaultdict(set), quality.score_quality(twice, model).collect()
    for x in rows:
        scores[x.doc_id % 9000 if x.doc_id is not None else None].add(x.score)
    assert len(rows) == twice.count() and all(len(v) == 1 for v in scores.values())


def test_statistics_against_plain_counts():
    texts = ["", "Aa b. Aa b. Aa b. Aa\nlongerthantwelve x x", "ééé 1 22 | $ <a@b>", " \n", "one"]
    (piece,) = slices_of(texts)
    got = quality.statistics(piece)
    n = len(quality._GROUPS) + 1
    for row, t in zip(got, texts):
        data, words = t.encode(), t.encode().split()
        low = [w.lower() for w in words]
        fours = [tuple(low[i : i + 4]) for i in range(len(low) - 3)]
        for k, codes in enumerate(quality._GROUPS.values()):
            assert abs(row[k] - sum(c in codes for c in data) / max(1, len(data))) < 1e-12
        sizes = [len(w) for w in words] or [0]
        p = np.array(list(Counter(data).values())) / max(1, len(data))
        want = [
            np.log1p(len(data)), np.log1p(len(words)), np.mean(sizes), np.std(sizes), sum(len(w) <= 3 for w in words) / max(1, len(words)), sum(len(w) > 12 for w in words) / max(1, len(words)),
            len(set(low)) / max(1, len(words)), len(set(fours)) / max(1, len(fours)), sum(a == b for a, b in zip(low, low[1:])) / max(1, len(words)), -(p * np.log2(p)).sum(), len(words) / (1 + data.count(10)),
        ]
        assert np.allclose(row[n:], want, atol=1e-6), t


def test_trees_walk_matches_nodes():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, np.ones(400), trees=20, depth=3)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            total += v[k - len(f)]
        assert abs(total - m.margin(row[None])[0]) < 1e-9


def test_no_label_reaches_held_out_rows(spark, labelled):
    docs, labels, _ = labelled
    changed = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.train(docs, x, steps=40).network.w for x in (labels, changed))
    assert all((a[k] == b[k]).all() for k in a)
    assert docs.filter(held_out()).count() > 100


def brute_repeats(rows, window):
    places = Counter()
    split = [(i, (t or "").encode().split()) for i, t, _ in rows]
    for _, w in split:
        places.update(tuple(w[s : s + window]) for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if places[tuple(w[s : s + window])] > 1:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [35, 8, 3])
def test_substring(spark, corpus, window):
    rows = corpus + [(300, " ".join("ab cd".split() * 60), "s"), (301, " ".join(["x"] * 50), "s")]
    got = substring.remove_repeats(table(spark, rows), window=window).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == brute_repeats(rows, window)


def test_substring_edges(spark, corpus):
    """Overfull prefixes are extended, and at last taken apart; hashes of 8 bits collide all over and change nothing."""
    assert substring.remove_repeats(empty(spark)).count() == 0
    for capacity, bits in ((16, 64), (2, 64), (300, 8)):
        got = substring.remove_repeats(table(spark, corpus), window=10, with_text=True, capacity=capacity, bits=bits).collect()
        assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == brute_repeats(corpus, 10), (capacity, bits)
    assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 for x in got if x.kept_text is not None)
    whole = {x.doc_id: x.repeats for x in got}[205] or []
    assert all(r.words >= 10 for r in whole)


def test_maximal_repeats(spark):
    """A passage of 47 words within other words is one repeat; two that touch in one document are two."""
    r = random.Random(3)
    word = lambda: f"u{r.randrange(10**9)}"
    a, b = [word() for _ in range(47)], [word() for _ in range(40)]
    rows = [(1, [word(), *a, word()]), (2, [word(), word(), *a]), (3, [*a, *b]), (4, [word(), *b, word()]), (5, [word() for _ in range(90)])]
    got = {x.doc_id: x for x in substring.remove_repeats(table(spark, [(i, " ".join(w), "s") for i, w in rows]), with_text=True).collect()}
    want = {1: [(1, 47)], 2: [(2, 47)], 3: [(0, 47), (47, 40)], 4: [(1, 40)], 5: None}
    assert {i: x.repeats and [tuple(p) for p in x.repeats] for i, x in got.items()} == want
    assert [got[i].n_removed for i in range(1, 6)] == [47, 47, 87, 40, 0]


def test_prefix_groups(spark):
    """Groups keep to the capacity while a longer prefix is left; equal first words end in one group of width 0."""
    r = random.Random(2)
    words = [[r.choice([1, 1, 1, 2, 200]) for _ in range(8)] for _ in range(2000)] + [[5] * 8] * 60
    codes = [int.from_bytes(bytes(w), "big", signed=True) for w in words]
    rows = spark.createDataFrame([(c,) for c in codes], "code long")
    got = substring.prefix_groups(rows, 50).collect()
    sizes = Counter((x.width, x.prefix) for x in got)
    assert len(got) == len(codes) and len({x.width for x in got}) > 3
    assert all(n <= 50 for (width, _), n in sizes.items() if width) and {x.code for x in got if not x.width} >= {codes[-1]}
    assert all(n > 50 for (width, _), n in sizes.items() if not width)


def test_suffix_tree_nodes():
    """Nodes at every depth are the classes of equal prefixes."""
    r = np.random.default_rng(4)
    rows = r.integers(1, 3, (200, 9))
    tree = substring.Tree(rows)
    for depth in range(10):
        node = tree.nodes(depth)
        for _ in range(200):
            i, j = r.integers(0, 200, 2)
            assert (node[i] == node[j]) == (rows[i, :depth] == rows[j, :depth]).all()


def test_packing(spark, corpus):
    got = packing.pack(table(spark, corpus)).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = {i: t or "" for i, t, _ in corpus}
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        part = np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4")
        assert x.length == len(part) > 0 and zlib.crc32(part.tobytes()) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
        pieces[x.doc_id] += range(x.start, x.start + x.length)
        sequences[x.sequence_id].append((x.offset, x.length))
    copies = Counter(i for i, _, _ in corpus)
    assert all(sorted(pieces[i]) == sorted([*range(len(ids[i]))] * copies[i]) for i in ids)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        total = sum(n for _, n in s)
        assert total <= 4096 and total & (total - 1) == 0  # no padding at all
    assert packing.pack(empty(spark)).count() == 0


def test_word_tokens_against_the_tokenizer():
    tokenizer, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokens(packing.default_tokenizer())
    r = random.Random(1)
    letters = ["a", "b", "Z", "é", "É", "ß", "Σ", "İ", ",", ".", ",,", "  ", " ", "\n", "\t", "—", "'s", "'", "1", "<|endoftext|>", "<|startoftext|>", "̈", "\x85", " ", "中", "×", "🙂", "\x1c", "ﬁ", "ǅ"]
    for _ in range(4000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        assert own.encode(own.split(s.encode()))[0].tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def brute_lague(votes, seats):
    got = {k: 0 for k in votes}
    for _ in range(seats):
        best = min((-v / (2 * got[k] + 1), k) for k, v in votes.items())
        if best[0] == 0:
            break
        got[best[1]] += 1
    return got


def test_sainte_lague_against_dealing_one_by_one(spark):
    r = random.Random(5)
    rows, want = [], {}
    for g in range(25):
        votes = {f"p{k}": float(r.choice([0, 1, 7, 50, 50, 1000])) for k in range(r.randint(1, 9))}
        seats = r.randint(0, 60)
        rows += [(g, k, v, seats) for k, v in votes.items()]
        want |= {(g, k): n for k, n in brute_lague(votes, seats).items()}
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, p string, v double, seats long"), ["g"], "p", "v", "seats").collect()
    assert {(x.g, x.p): x.quota for x in got} == want


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, total = dict(sizes), {}, 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] >= 2 * sizes[s]]
        for s in over or list(left):
            out[s] = 2 * sizes[s] if over else level * weight[s]
            del left[s]
    return out


def test_mixing(spark, corpus):
    rows = [(i, t, "big" if (i or 0) % 2 else s) for i, t, s in corpus]
    got = mixing.mix(table(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    words = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += words[i]
    want = brute_targets(dict(sizes))
    for x in got:
        s = source[x.doc_id]
        assert x["size"] == words[x.doc_id] and x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 and 0 <= x.taken <= 2 * x["size"]
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
    again = mixing.mix(table(spark, rows[::-1]).repartition(5)).collect()
    assert Counter(got) == Counter(again)
    assert mixing.mix(empty(spark)).count() == 0
    plan = mixing.mix(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark, labelled, tmp_path):
    import corpus_pipeline as P

    docs, labels, truth = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    copy = docs.filter("doc_id = 7").selectExpr("doc_id + 5000 AS doc_id", "text", "source", "size", "kept", "row", "shard")
    near = docs.filter("doc_id = 11").selectExpr("doc_id + 6000 AS doc_id", "concat(text, ' addition') AS text", "source", "size", "kept", "row", "shard")
    now = docs.unionByName(copy).unionByName(near)
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    seen = []
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, now, str(tmp_path)), "t")
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            clean = {i for i, (_, t) in truth.items() if not t}
            assert len(clean & seen[-1]) > 0.93 * len(clean) and len(seen[-1] - clean) < 0.1 * len(clean)
        elif name == "exact dedup":
            assert 5007 in seen[-1] and 7 not in seen[-1] and out.count() == now.select("text").na.fill("").distinct().count()
        elif name == "near dedup":
            assert 11 in seen[-1] and 6011 not in seen[-1] and out.count() == minhash.near_duplicates(now).filter("kept").count()
        elif name == "mixing":
            assert seen[-1] <= seen[-2] and max(Counter(r.doc_id for r in out.collect()).values()) <= 2
        else:
            assert seen[-1] == seen[-2]
        now = out


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline as P

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_query_names(spark, sf_dir):
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.queries())
    assert numbers == list(range(1, 11)) and set(Q.oracle_sql()) <= set(Q.queries())


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in Q.oracle_sql().items():
        want = con.execute(sql).df()
        got = Q.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
        assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values)), name
