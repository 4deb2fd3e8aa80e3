"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweir.llm import components, decontam, edits, hashing, lines, media, packing, paragraphs, pii, quality, segments, simhash, suffix, tokens

paragraphs_marks = ".,;:!?\"'()[]"
KIND = "doc_id long, text string, extra string, n_chars long, fp string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta", "iota", "kappa"]) + rng.choice(["", "x", "yz", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(25)]
    out = []
    for t in base:
        out.append(t)
        if rng.random() < 0.5:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if rng.random() < 0.3:
            out.append(t + "\n" + rng.choice(base))
    long = "\n".join(words(rng, 200) for _ in range(60))
    return [*out, None, "", " \n\t ", base[0], base[0], long, "a" * 3000, "é" * 500, "ab" * 700]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows, one id with two texts, and null ids."""
    t = "one two three four five six seven eight nine ten eleven twelve. " * 3
    return spark.createDataFrame([(1, t), (1, t), (1, "other " + t), (None, t), (None, None)], "doc_id long, text string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    want = groups(range(300), edges)
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert all(want[n] == r for n, r in got.items()) and {n for n, r in want.items() if r != n} <= set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------------------------ tokens, packing


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def crc(own):
    return zlib.crc32(np.array(own, "<u4").tobytes())


def test_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.vocabulary()), tokens.encoder(tokens.WORD_BPE)
    rng = random.Random(2)
    odd = ["a<|endoftext|>b", "İstanbul ΣΑΣ ﬁ é", "x y z", "it's we'll THE'D", "\x1c\x00 a\x85b", "日本語 テスト ١٢٣", "😀👍🏽 ok", "¼ ² 5a6"]
    odd += ["".join(chr(rng.choice([*range(32, 591), 0x301, 0x3A3, 0x4E00, 0x1F600])) for _ in range(60)) for _ in range(150)]
    flat, off = e.encode(pa.array([*odd, None]))
    assert [flat[i:j].tolist() for i, j in zip(off[:-1], off[1:], strict=True)] == [*(t.encode(x, add_special_tokens=False).ids for x in odd), []]
    other = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    flat, _ = other.encode(pa.array(["Hello there"]))
    assert flat.tolist() == Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")).encode("Hello there", add_special_tokens=False).ids


def test_token_orc(docs, ids, empty, repeated, spark, tmp_path):
    at, want = 0, []
    for i, own in enumerate(ids):
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert rows(tokens.token_files(docs), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    path = f"file://{tmp_path}/t.orc"
    tokens.write_token_orc(docs, path)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.read_token_orc(spark, path).collect()}
    assert got == dict(enumerate(ids))
    plan = spark.read.orc(path).where("doc_id = 3")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,3)" in plan
    assert tokens.token_files(empty).count() == 0
    starts = [r[0] for r in rows(tokens.token_files(repeated), "start", "n_tokens")]
    assert len(starts) == 5 and 0 in starts


def test_token_orc_by_id_reads_few_rows(spark, tmp_path):
    """Rows that readers decode for an id: a group's, or none if the Bloom filter tells that it isn't there."""
    path = f"file://{tmp_path}/t.orc"
    docs = spark.range(6000).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("words of "), F.col("id")).alias("text"))
    tokens.write_token_orc(docs.repartition(4), path)

    def read(*own):
        df = tokens.documents_of(spark, path, list(own))
        found = sorted(r["doc_id"] for r in df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().apply("numOutputRows").value()

    found, rows_ = read(700)
    assert found == [700] and 0 < rows_ <= 1000
    assert read(701)[0] == [] and read(702)[1] == 0
    found, rows_ = read(0, 7 * 5999)
    assert found == [0, 7 * 5999] and rows_ <= 2000


def test_encoder_slices_and_odd_characters():
    """Slices of an Arrow array, characters whose lower case grows, marks around words, spaces of every kind."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    signs = "ab'stréÉÀİıﬁ\u0301   \t\n.,!?(-1٣½ªµſǅŒßØ日\u2019\u201c\x85\x1cΣςΑ\U0001f600"
    own = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(1500)]
    own += ["don't 's can'ts we'll're ''s x'' ÉTÉ! été's (l'été)", "<|endoftext|> x", "İ", "İ!!", "", None]
    enc, plain = tokens.Encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    for part in (pa.array(own), pa.array(own).slice(700), pa.array(own).slice(3, 40)):
        got, off = enc.encode(part)
        assert [got[i:j].tolist() for i, j in zip(off[:-1], off[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]


def test_packing(docs, ids, empty, repeated):
    got = packing.pack(docs, with_ids=True).collect()
    have = {i: [] for i in range(len(ids))}
    for r in got:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == crc(own) and r["doc_tokens"] == len(ids[r["doc_id"]])
        have[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert all(sorted(v) == list(range(len(ids[i]))) for i, v in have.items())
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= packing.SIZE
    assert packing.pack(empty).count() == 0 and packing.pack(repeated).count() == 5


def test_packing_plan_is_tight():
    rng = random.Random(3)
    histogram = {}
    for _ in range(40_000):
        c = min(512, 1 + int(rng.expovariate(1 / 90)))
        histogram[c] = histogram.get(c, 0) + 1
    table = packing.plan(histogram, 512)
    used = {}
    for c, t in table.items():
        ends = [*t[1:, 0].tolist(), histogram[c]]
        for (first, a, seq, _), end in zip(t.tolist(), ends, strict=True):
            assert (end - first) % a == 0
            for k in range((end - first) // a):
                used[seq + k] = used.get(seq + k, 0) + a * c
    assert max(used.values()) <= 512 and set(used) == set(range(len(used)))
    assert sum(c * n for c, n in histogram.items()) / (512 * len(used)) > 0.99
    value, count = packing.knapsack(np.array([3.0, 4.0, 5.0]), np.array([3, 4, 5]), 11)
    assert value == 11 and count @ np.array([3, 4, 5]) == 11


# ------------------------------------------------------------------------------------------ personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(5)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1.9.9.9.9", "4539 1488 0343 6467", "4539148803436467", "+1 (555) 123-4567", "+", "12", " ", ".", "-", "é", "a@b.c@d.e.f", "00001.2.3.4", "5500005555555559 ", "+49.30.1234567.."]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in BASE] == brute_spans(t), t


def test_further_spans_and_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"] and kinds("IBAN DE88370400440532013000") == []
    assert "national_id" in kinds("my SSN is 123-45-6789") and "national_id" not in kinds("order 123-45-6789")
    assert kinds("password=e3b0c44298fc") == ["secret"]
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468") and pii.mod97("GB82 WEST 1234 5698 7654 32")


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "a@" * 50_000, "9" * 5000 + ".1.1.1"):
        pii.find_spans(t)


def test_further_kinds_by_length_and_context():
    def found(text):
        return [(s[0], text[s[1] : s[2]]) for s in pii.find_spans(text) if s[0] not in BASE]

    assert found("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("DE89370400440532013000 EUR 100, XX89370400440532013000") == [("iban", "DE89370400440532013000")]
    assert found("DE89 3704 0044 0532 0130 01") == [] and found("DE89 3704 0044 0532 0130 00X") == []
    secret = "x" * 3000
    assert found(f"password={secret} end") == [("secret", secret)]
    assert found("token: abcdefghij on page 7") == [] and found("login token: abcdefghij on page 7") == [("secret", "abcdefghij")]
    for word in ("international call", "syntax", "socially"):
        assert found(f"{word} 123-45-6789") == []
    assert found("tax 123-45-6789") == found("Tax: 123-45-6789") == [("national_id", "123-45-6789")]
    assert found("national 85073003328") == [("national_id", "85073003328")] and found("national 85073003329") == []
    nir = "2550867890123"
    assert found(f"social {nir}{97 - int(nir) % 97:02}") == [("national_id", f"{nir}{97 - int(nir) % 97:02}")]


def test_personal_data(spark, empty, docs, texts):
    t = "mail a@b.cd or 10.0.0.1"
    df = spark.createDataFrame([(1, t), (1, t), (2, None)], "doc_id long, text string")
    got = pii.span_digests(pii.personal_data(df)).collect()
    digest = hashlib.sha256(b"email:5:11,ip:15:23").hexdigest()
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["base_sha256"]) for r in got)[:2] == [(1, 1, 1, digest)] * 2
    assert {r["redacted"] for r in pii.personal_data(df).collect()} == {"mail <email> or <ip>", ""}
    assert pii.personal_data(empty).count() == 0 and pii.personal_data(docs).count() == len(texts)


# ------------------------------------------------------------------------------------------ media


def test_media(docs, texts, empty, repeated):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        p, r = media.payload_of(t or ""), got[i]
        assert r["n_bytes"] == len((t or "").encode()) and r["payload_bytes"] == len(p) and len(p) % 576 == 0 and len(p) > 0
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-32:])
        png = media.to_png(p)
        assert media.from_png(png) == p and r["media_bytes"] == len(png) and r["media_sha256"] == hashlib.sha256(png).hexdigest()
    assert len({(r["shard"], r["offset"]) for r in got.values()}) == len({media.payload_of(t or "") for t in texts})
    assert media.media_columns(empty).count() == 0 and media.media_columns(repeated).count() == 5


def test_shards(docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    index = media.staged(media.write_shards(docs, folder, shard_bytes=4096), "index")
    at = media.places(index)
    assert {(r["width"], r["bits"]) for r in media.metadata(at, folder).collect()} == {(576, 8)}
    r = at.first()
    data = media.read_member(folder, r["shard"], r["offset"], r["length"])
    assert hashlib.sha256(media.from_png(data)).hexdigest() == r["digest"]
    assert (r["digest"], r["offset"], r["length"]) in media.list_shard(folder, r["shard"])
    broken = bytearray(data)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


# ------------------------------------------------------------------------------------------ decontamination


def test_decontamination(spark, docs, texts, empty):
    items = [(1, texts[0]), (2, "Alpha, BETA"), (3, None), (4, "..."), (5, texts[3]), (6, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for k, t in items:
        w = decontam.words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    want = []
    for i, t in enumerate(texts):
        w, hit, own = decontam.words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    own |= found
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (decontam.BLOCK_WORDS, 60):
        assert rows(decontam.hit_digests(decontam.scan(docs, bench, block_words=block)), *cols) == sorted(want, key=repr)
    none = bench.limit(0)
    assert decontam.scan(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.hit_digests(decontam.scan(docs, none)).collect())
    kept = {r["doc_id"]: r for r in decontam.remove_hits(docs, bench).collect()}
    for i, n, h, *_ in want:
        assert (i in kept) == (not h or h < n)
        if i in kept:
            assert len(decontam.words(kept[i]["text"])) == n - h and (h or kept[i]["text"] == texts[i])
            assert kept[i]["text"] is None or kept[i]["n_chars"] == len(kept[i]["text"])
    assert decontam.remove_hits(docs, bench).columns == docs.columns


# ------------------------------------------------------------------------------------------ quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["predicted"] == got["quality"]).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"])
    assert got["score"].between(0, 1).all()


def test_quality_edges(spark, docs, texts, empty, repeated):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (2, 1), (None, 1), (3, None), (4, 1), (5, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0 and quality.classify(repeated, labels).count() == 5
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(2, 0.5, (800, 3))])
    y = np.repeat([0, 1], [500, 800])
    n = np.array([500.0, 800.0])
    m = quality.Discriminant.fit(n, np.stack([x[y == c].sum(0) for c in (0, 1)]), np.stack([x[y == c].T @ x[y == c] for c in (0, 1)]), shrink=0)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.98
    s = np.cov(rng.normal(0, 1, (50, 12)).T)
    low = quality.cholesky(s)
    assert np.allclose(low @ low.T, s) and np.allclose(quality.inverse_of(low) @ low, np.eye(12)) and not np.triu(low, 1).any()


# ------------------------------------------------------------------------------------------ SimHash


def test_simhash(spark, docs, texts, empty, repeated):
    import xxhash

    def brute(t):
        w = (t or "").encode().translate(simhash._LOWER).split()
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = [brute(t) for t in texts]
    assert [simhash.fingerprint(t or "") for t in texts] == fp
    want = groups(range(len(fp)), [(a, b) for a, b in combinations(range(len(fp)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = rows(simhash.hexed(simhash.near_duplicates(docs)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((i, f"{f:016x}", want[i]) for i, f in enumerate(fp)), key=repr)
    assert len(set(want.values())) < len(texts)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(repeated).count() == 5
    assert rows(simhash.keep_one(docs), "doc_id") == sorted(((i,) for i in set(want.values())), key=repr)


def test_keep_one_judges_each_row_by_its_text(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(4))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, d), (7, c), (8, None)], "doc_id long, text string").repartition(3)
    assert rows(simhash.keep_one(df), "doc_id", "text") == sorted([(1, a), (5, b), (7, c), (None, d), (8, None)], key=repr)
    assert rows(simhash.keep_one(df.where("doc_id is null")), "text") == sorted([(a,), (c,), (d,)], key=repr)


def test_every_layout_finds_all_links():
    rng = np.random.default_rng(2)
    fp = set(map(int, rng.integers(0, 2**63, 100, dtype=np.uint64)))
    for b in list(fp)[:10]:
        for _ in range(90):
            x = b
            for i in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(i)
            fp.add(x)
    fp = np.array(sorted(fp), np.uint64)
    want = groups(fp.tolist(), [(a, b) for a, b in combinations(fp.tolist(), 2) if (a ^ b).bit_count() <= 4])
    for n, joined in ((3, 1), (5, 2)):
        assert simhash.covers(n, joined, 4)
        m = simhash.variants(n, joined)
        v, f = np.repeat(np.arange(len(m)), len(fp)), np.tile(fp, len(m))
        o = np.lexsort((f & m[v], v))
        assert groups(fp.tolist(), simhash._pairs(v[o], f[o], m, 4).tolist()) == want
    assert not simhash.covers(2, 1, 4) and simhash.layout(10**5) == (3, 1) and simhash.layout(10**10)[1] > 1


# ------------------------------------------------------------------------------------------ lines


def linked_lines(a, b):
    """The rule of line links, by a plain distance."""
    u, v = a.encode().split(), b.encode().split()
    n = min(len(u), len(v))
    if n >= 20:
        return edits._plain(u, v) <= n // 10
    return edits._plain(a, b) <= min(2, min(len(a), len(b)) // 10)


def near_pairs(own):
    return [(a, b) for a, b in combinations(sorted(own), 2) if abs(len(a) - len(b)) <= 3 + max(len(a), len(b)) // 3 and linked_lines(a, b)]


def altered(rng, own, most, symbols):
    own = list(own)
    for _ in range(rng.randrange(most + 1)):
        i = rng.randrange(len(own) + 1)
        own[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(symbols)]])
    return own


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(2000):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        b = "".join(altered(rng, a, 5, "ac"))
        for tau in (1, 2, 3):
            assert edits.within(a, b, tau) == (edits._plain(a, b) <= tau)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(60, 200)))
        b = "".join(altered(rng, a, 60, "ax"))
        d = edits._plain(a, b)
        for tau in {d - 1, d, 20, 40} - {-1}:
            assert edits.within(a, b, tau) == (d <= tau)


def test_edit_distance_of_many_pairs():
    rng = random.Random(8)
    for tau in (1, 2, 5, 12, 31):
        own = []
        for _ in range(60):
            base = [rng.randrange(6) for _ in range(rng.randrange(3 * tau + 12))]
            own += [base, *(altered(rng, base, tau + 2, range(6)) for _ in range(3))]
        n = np.array([len(w) for w in own])
        sym = np.full((len(own), n.max()), -1, np.int32)
        for i, w in enumerate(own):
            sym[i, : len(w)] = w
        pairs = [sorted((i, j), key=lambda k: n[k]) for i in range(len(own)) for j in range(max(0, i - 4), i) if abs(n[i] - n[j]) <= tau]
        got = edits.within_pairs(sym, n, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.full(len(pairs), tau))
        assert got.tolist() == [edits._plain(own[i], own[j]) <= tau for i, j in pairs]


def test_keys_miss_no_pair():
    """Each linked pair has a key under which the shorter line is indexed and the other one probes."""
    rng = random.Random(9)
    some = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    pairs = []
    for n in [*range(1, 45), 60, 99, 100, 101, 250]:
        for _ in range(12):
            w = [rng.choice(some) for _ in range(n)]
            v = altered(rng, w, n // 9 + 1, some) if n >= 18 and rng.random() < 0.8 else list("".join(altered(rng, " ".join(w), 3, "ab ")).split())
            pairs.append((" ".join(w), " ".join(v) or "x"))
    own = segments.Lines([s for p in pairs for s in p])
    key, line, probe, words_, place = segments.keys(own)
    roles = [set(), set()]
    for k, i, p, w, at in zip(key.tolist(), line.tolist(), probe.tolist(), words_.tolist(), place.tolist(), strict=True):
        roles[p].add((i, k, w, at))
    linked = 0
    for i, (a, b) in enumerate(pairs):
        if a != b and linked_lines(a, b):
            x, y = 2 * i, 2 * i + 1
            by_words = min(own.words[x], own.words[y]) >= 20
            n = own.words if by_words else own.chars
            x, y = (x, y) if n[x] <= n[y] else (y, x)
            linked += 1
            tau = n[x] // 10
            mine, other = ([(k, at) for j, k, w, at in roles[r] if j == i and w == by_words] for r, i in ((0, x), (1, y)))
            assert any(k == m and abs(at - p) <= tau for k, at in mine for m, p in other)
    assert linked > 150


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(6)
    base = [words(rng, rng.randrange(2, 20)) for _ in range(40)]
    out = []
    for i in range(120):
        own = []
        for _ in range(rng.randrange(0, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                s[rng.randrange(len(s))] = rng.choice("qwé")
            own.append(rng.choice(["", " "]) + "".join(s))
        out.append((i, "\n".join(own), len("\n".join(own))))
    out += [(200, None, None), (201, "\n \n", 3)]
    return spark.createDataFrame(out, "doc_id long, text string, n_chars long").repartition(3), [r[:2] for r in out]


def test_rows_that_go_before_the_sort():
    rng = np.random.default_rng(5)
    n = 40_000
    key, ident = rng.integers(0, 1 << 48, n, dtype=np.uint64), rng.integers(0, 1 << 48, n)
    meta = rng.integers(0, 2, n).astype(np.uint16)
    # Every tenth row has an earlier one's key: of its line, or of another one; and keys of one bucket are alike below.
    key[::10] = key[5::10]
    key *= np.uint64(64)
    ident[:20_000:10] = ident[5:20_000:10]
    left = lines._contested(key, ident, meta)
    of: dict[int, list] = {}
    for k, i, m in zip(key.tolist(), ident.tolist(), meta.tolist(), strict=True):
        of.setdefault(k, []).append((i, m))
    want = np.array([len({i for i, _ in of[k]}) > 1 and len({m for _, m in of[k]}) > 1 for k in key.tolist()])
    assert want.any() and left[want].all() and left.sum() < n / 2
    none = np.empty(0, np.uint64)
    assert not len(lines._contested(none, none.view(np.int64), meta[:0]))


def test_words_by_eights():
    rng = random.Random(8)
    own = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 200, 5000) for _ in range(60)]
    texts, flat = ["", *(" ".join(own[i : i + 7]) for i in range(0, len(own), 7)), " \t", " ".join(reversed(own))], [*own, *reversed(own)]
    w = hashing.Words(texts, eights=True)
    assert w.count.tolist() == [len(t.split()) for t in texts]
    known = dict(zip(flat, w.hash.tolist(), strict=True))
    assert [known[x] for x in flat] == w.hash.tolist() and len(set(known.values())) == len(known)
    assert not len(hashing.Words([], eights=True).hash) and not len(hashing.Words([""], eights=True).hash)


def test_parts_make_the_same_rows(monkeypatch):
    rng = random.Random(9)
    own = sorted({words(rng, rng.randrange(1, 60)) for _ in range(300)} | {"a" * 3000, "é" * 500})

    def rows():
        found = [np.stack(lines.unpacked_all([body], lines.ROW)) for _, body in lines._blocks(own, 3)]
        return sorted(map(tuple, np.concatenate(found, axis=1).T.tolist()))

    whole = rows()
    monkeypatch.setattr(lines, "PART", 1000)
    assert whole and rows() == whole


def test_line_join(lined, empty, repeated):
    df, docs = lined
    occ = [(i, n, s) for i, t in docs for n, s in lines.lines_of(t or "")]
    first = {}
    for i, n, s in occ:
        first.setdefault(s, (i, n))
    near = near_pairs(first)
    root = groups(first, near)
    keep, degree = {}, {}
    for s, p in first.items():
        keep[root[s]] = min(keep.get(root[s], p), p)
    for a, b in near:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert len(near) > 20
    want = []
    for i, t in docs:
        own = lines.lines_of(t or "")
        drop = [n for n, s in own if keep[root[s]] != (i, n)]
        want.append((i, min((keep[root[s]][0] for _, s in own), default=i), len(own), len(drop), sum(degree.get(s, 0) for _, s in own), hashlib.sha256(lines._without(t or "", drop).encode()).hexdigest()))
    assert rows(lines.line_report(df), "doc_id", "class_id", "n_lines", "n_removed", "n_links", "kept_sha256") == sorted(want, key=repr)
    kept = {r["doc_id"]: r for r in lines.remove_lines(df).collect()}
    for i, _, n, gone, _, digest in want:
        assert (i in kept) == (gone < n or not n)
        if i in kept and gone:
            assert hashlib.sha256(kept[i]["text"].encode()).hexdigest() == digest and kept[i]["n_chars"] == len(kept[i]["text"])
    assert lines.line_report(empty).count() == 0 and lines.line_report(repeated).count() == 5
    assert lines.remove_lines(empty).columns == empty.columns


def test_edits_grow_with_the_line(spark):
    rng = random.Random(15)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    own = ["ab", "ac", "short line", "short lime", "short  limes", "a line of 2l chars xy", "a line of 21 char xyz"]
    for n in (4, 5, 6, 8, 9, 10, 12, 19, 20, 21, 30, 60, 100, 200, 400):
        for _ in range(8):
            w = [rng.choice(some) for _ in range(n)]
            own.append(" ".join(w))
            for _ in range(2):
                v = list(w)
                for i in rng.sample(range(n), max(1, n // rng.choice([9, 11, 14, 25]))):
                    v[i] = rng.choice(some)
                own += [" ".join(v), "".join(altered(rng, " ".join(w), 2, "ab ")).strip()]
    own = sorted(set(own))
    pairs = near_pairs(own)
    assert len(pairs) > 300 and sum(edits.within(a, b, 2) for a, b in pairs) < 0.7 * len(pairs)
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    assert dict(rows(lines.line_report(df), "doc_id", "n_links")) == {i: sum(s in p for p in pairs) for i, s in enumerate(own)}
    assert lines.remove_lines(df).count() == len(set(groups(own, pairs).values()))


def test_many_lines_under_one_key(spark):
    """Hundreds of lines that share a passage: some alike, some not, some longer; buckets of several blocks."""
    rng = random.Random(16)
    some = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    passage = [rng.choice(some) for _ in range(30)]
    own = set()
    for i in range(160):
        own.add(" ".join(altered(rng, passage, 3, some)))
        own.add(" ".join([*passage, *(rng.choice(some) for _ in range(20 + i % 7))]))
    own = sorted(own)
    pairs = near_pairs(own)
    assert len(pairs) > 2000
    docs = list(enumerate(own)) + [(1000 + i, s) for i, s in enumerate(own[::3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = {i: sum(s in p for p in pairs) for i, s in enumerate(own)}
    want |= {1000 + i: want[3 * i] for i in range(len(own[::3]))}
    assert dict(rows(lines.line_report(df), "doc_id", "n_links")) == want
    met = lines.links(df, 7)
    assert met.where("b is null").agg({"n": "sum"}).first()[0] == 2 * len(pairs)


def test_lines_that_share_only_a_passage_are_not_fetched(spark):
    """Of hundreds of lines under the keys of one passage, only those with a partner go on to the comparison of texts."""
    rng = random.Random(18)
    some = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(9000)]
    passage = [rng.choice(some) for _ in range(14)]
    own, near = [], set()
    for i in range(300):
        w = [rng.choice(some) for _ in range(80 + i % 9)]
        w[30:30] = passage
        own.append(" ".join(w))
        if i % 30 == 0:
            w[rng.randrange(20)] = "changed"
            near |= {own[-1], " ".join(w)}
            own.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(5)
    met = lines.staged(lines.meetings(df, 3), "meetings")
    left = lines.likely(met, lines.wanted_texts(df, met.select("id").distinct()))
    ids = lambda df: {r[0] for r in df.select("id").collect()}
    want, common = {lines.short(lines.digest(s)) for s in near}, f"role >= {lines.COMMON}"
    assert want <= ids(left) and ids(left.where(common)) <= want and len(ids(met.where(common)) - want) > 150
    assert dict(rows(lines.line_report(df), "doc_id", "n_links")) == {i: int(s in near) for i, s in enumerate(own)}
    assert lines.remove_lines(df).count() == 300


# ------------------------------------------------------------------------------------------ paragraphs


def shingle_set(line, width=5):
    w = line.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_paragraphs(docs, texts, empty, repeated):
    first, places = {}, {}
    for i, t in enumerate(texts):
        places[i] = lines.lines_of(t or "")
        for n, s in places[i]:
            first.setdefault(s, (i, n))
    sets = {s: shingle_set(s) for s in first}
    near = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near
    root, keep = groups(first, near), {}
    for s, p in first.items():
        keep[root[s]] = min(keep.get(root[s], p), p)
    want = []
    for i, t in enumerate(texts):
        gone = [n for n, s in places[i] if keep[root[s]] != (i, n)]
        want.append((i, min([i, *(keep[root[s]][0] for _, s in places[i])]), len(places[i]), len(gone), paragraphs.without(t or "", gone)))
    got = rows(paragraphs.remove_paragraphs(docs), "doc_id", "class_id", "n_paragraphs", "n_removed", "kept")
    assert got == sorted(want, key=repr)
    assert paragraphs.remove_paragraphs(empty, passage=30).count() == 0 and paragraphs.remove_paragraphs(repeated, passage=30).count() == 5
    bands, r = paragraphs.tune()
    assert 1 - (1 - 0.8**r) ** bands >= paragraphs.RECALL


def test_recall_of_the_banding():
    """Pairs at and above the similarity: the share that collides in some band."""
    rng = random.Random(12)
    some = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    pairs = []
    while len(pairs) < 400:
        w = [rng.choice(some) for _ in range(rng.randrange(40, 160))]
        v = list(w)
        for _ in range(rng.randrange(1, 4)):
            v[rng.randrange(len(v))] = rng.choice(some)
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(v))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            pairs.append((" ".join(w), " ".join(v)))
    keys = paragraphs._band_keys([s for p in pairs for s in p], 5, *paragraphs.tune())
    assert (keys[:, ::2] == keys[:, 1::2]).any(0).mean() >= 0.99


def test_joined_texts_under_one_key():
    rng = random.Random(13)
    some = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(200)]
    own = []
    for _ in range(12):
        w = [rng.choice(some) for _ in range(rng.randrange(1, 60))]
        own += [" ".join(altered(rng, w, 2, some)) or "x" for _ in range(12)]
    own = sorted(set(own))
    sets = {s: shingle_set(s) for s in own}
    near = [(a, b) for a, b in combinations(own, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got, a, b = paragraphs.joined_texts(np.zeros(len(own), np.int64), own, 0.8, 5, None)
    assert groups(own, near) == groups(own, [(got[i], got[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    by_edits = [(a, b) for a, b in combinations(own, 2) if (a, b) in set(near) or edits._plain(a, b) <= 4]
    got, a, b = paragraphs.joined_texts(np.zeros(len(own), np.int64), own, 0.8, 5, 4)
    assert groups(own, by_edits) == groups(own, [(got[i], got[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])


def test_joined_texts_under_common_keys():
    """Hundreds of paragraphs under two keys, near copies of some and others that only share a passage: all near pairs
    are joined, and few others are compared."""
    rng = random.Random(19)
    some = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    passage = [rng.choice(some) for _ in range(40)]
    own = [" ".join([*passage, *(rng.choice(some) for _ in range(rng.randrange(5, 60)))]) for _ in range(300)]
    for k in (9, 200):
        w = [rng.choice(some) for _ in range(k)]
        own += [" ".join(altered(rng, w, 2, some)) for _ in range(100)]
    own = sorted(set(own))
    sets = {s: shingle_set(s) for s in own}
    near = {(a, b) for a, b in combinations(own, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) > 300
    got, a, b = paragraphs.joined_texts(np.repeat([3, 5], len(own)), own * 2, 0.8, 5, None)
    assert groups(own, near) == groups(own, [(got[i], got[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    who = np.repeat(np.arange(len(own)), [len(sets[s]) for s in own])
    code = {}
    h = np.array([code.setdefault(x, len(code)) for s in own for x in sorted(sets[s])], np.uint64)
    pairs = {(own[i], own[j]) for x, y in paragraphs._sharing(who, h, np.bincount(who), 0.8) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert near <= {tuple(sorted(p)) for p in pairs} and len(pairs) < len(own) ** 2 / 10


def test_short_paragraphs(spark):
    texts = ["a b c d e f g\nYes, sir.\nonly here", "A b c d e f g\nyes, sir.\nno, sir.", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(paragraphs.remove_paragraphs(df), "doc_id", "n_paragraphs", "n_removed", "kept")
    assert got == [(0, 3, 0, texts[0]), (1, 3, 2, "no, sir."), (2, 1, 0, "x")]


def test_passages_in_paragraphs(spark):
    rng = random.Random(21)
    new = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    run, other, one = new(35), new(29), new(12) + "."
    a = [new(40) + " " + run + " " + new(40), new(25), other + " " + new(50), new(30) + ". " + one + " " + new(30)]
    head, tail, line, end = new(60), new(50), new(40), new(45)
    texts = ["\n".join(a), head + " " + run.upper() + "; " + tail, new(30) + "\n" + line + " " + run[:118] + "\n" + run[119:] + " " + end, new(50) + " " + other, one + "\n" + new(20)]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (9, "")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in paragraphs.remove_paragraphs(df, passage=30).collect()}
    kept = {i: r["kept"] for i, r in got.items()}
    assert kept[0] == texts[0] and kept[3] == texts[3] and kept[None] == kept[9] == "" and len(got) == 7
    assert kept[1].split() == [*head.split(), *([";"] if ";" in kept[1] else []), *tail.split()] and got[1]["class_id"] == 0
    assert run.split()[3] not in kept[2] and line in kept[2] and end in kept[2]
    # A sentence of another paragraph is neither a paragraph nor long enough for a passage.
    assert kept[4] == texts[4] and got[4]["n_removed"] == 0


@pytest.mark.parametrize("passage", [6, 7])
def test_passages_equal_brute_force(spark, passage):
    rng = random.Random(22)
    few = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    runs = [[rng.choice(few) for _ in range(rng.randrange(4, 25))] for _ in range(12)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(runs) if rng.random() < 0.6 else [rng.choice(few) for _ in range(rng.randrange(1, 20))]
        w = [x.upper() if x.isascii() and rng.random() < 0.2 else x + rng.choice(["", "", ",", ".)", " ..."]) for x in w]
        texts.append("".join(x + rng.choice([" ", " ", "\n", "\t"]) for x in w))
    texts += ["", "a b c", "a " * 40, "b " * 5]
    plain = lambda x: (x.lower().strip(paragraphs_marks) or x.lower())
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = [plain(x) for x in t.split()]
        for at in range(len(w) - passage + 1):
            key = tuple(w[at : at + passage])
            if key in seen:
                want.setdefault(i, set()).add(at)
            seen.add(key)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, of long, kept string").repartition(4)
    got = {r["doc_id"]: set(r["cut"]) for r in paragraphs.passages(docs, passage, 3).collect()}
    assert got == want and len(want) > 20


# ------------------------------------------------------------------------------------------ suffix arrays


def brute_repeats(pairs, length=100):
    seen, out = set(), {}
    for i, t in pairs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(8)
    for k in range(150):
        x = np.array([rng.randrange(0, rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 150))] * (1 + k % 3), np.int16)
        assert suffix.suffix_array(x, 60).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    for _ in range(80):
        base = [bytes(rng.choice(b"ab\0c") for _ in range(40)) for _ in range(4)]
        pieces = [rng.choice(base)[rng.randrange(20) :][: rng.randrange(1, 20)] for _ in range(8)]
        doc, start = np.array([rng.randrange(3) for _ in pieces]), np.arange(8) * 100
        seen = {}
        for p, d, s in zip(pieces, doc.tolist(), start.tolist(), strict=True):
            for i in range(len(p) - 4):
                seen.setdefault(p[i : i + 5], set()).add((d, s + i))
        d, s = suffix.repeats(pieces, doc, start, 5)
        assert set(zip(d.tolist(), s.tolist(), strict=True)) == {x for v in seen.values() for x in v if x != min(v)}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    part = bytes(rng.choice(b"abc ") for _ in range(100))
    at = []
    for n in (0, 17, 400):
        raw = bytes(rng.choice(b"xyz") for _ in range(n)) + part + bytes(rng.choice(b"uvw") for _ in range(50))
        p, _ = suffix.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
        at.append({x - n for x in p.tolist() if 0 <= x - n <= 76})
    assert at[0] & at[1] & at[2]


@pytest.mark.parametrize("giant", [suffix.GIANT, 2])
def test_repeats(spark, docs, texts, empty, repeated, giant):
    want = brute_repeats(list(enumerate(texts)))
    assert any(w[1] for w in want.values())
    got = suffix.repeat_digests(suffix.remove_repeats(docs, giant=giant))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *w) for i, w in want.items()), key=repr)
    assert suffix.remove_repeats(empty, giant=giant).count() == 0 and suffix.remove_repeats(repeated, giant=giant).count() == 5


# ------------------------------------------------------------------------------------------ the pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert len(names) == 5
    for _, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        docs = c.staged(docs, "kept")
    assert docs.select("doc_id").distinct().count() == docs.count()
    packed = c.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


CLASH = ["__id", "__of", "__drop", "__new", "__score", "__kept", "__words", "__bits", "__items", "__ID", "__r_id", "__some"]


def _corpus(spark, path, rows):
    """documents with columns that clash with names inside the stages, labels and benchmark, as tables of a folder."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH if c != "__ID")
    own = [(i, t, "en", "s", None if t is None else len(t), *("x" * (len(CLASH) - 1))) for i, t in rows]
    spark.createDataFrame(own, kind).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, 0) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark words that nobody else would ever write in this order")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_edge_cases(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, clashing columns: each stage keeps columns, and
    rows that it has no reason to drop."""
    import corpus_pipeline as c

    rng = random.Random(31)
    new = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    one, two, shared = new(40), new(50), new(25)
    rows = [(1, one), (1, one), (1, two), (None, new(30)), (None, None), (2, ""), (3, None), (4, shared + "\n" + new(30)), (5, shared + "\n" + new(30)), (6, new(4000))]
    rows.append((7, new(20) + " some benchmark words that nobody else would ever write in this order " + new(20)))
    sf = _corpus(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(c.STAGES)
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    lined = stages["line dedup"](spark, docs, sf)
    got = {r["doc_id"]: r for r in lined.where("doc_id in (4, 5, 6)").collect()}
    assert got[4]["text"].startswith(shared) and shared not in got[5]["text"] and got[5]["n_chars"] == len(got[5]["text"])
    # Repeated rows under one id are one document: both stay.
    assert lined.count() == len(rows) and lined.where("doc_id = 1").count() == 3
    single = stages["simhash near-dedup"](spark, docs, sf)
    assert single.where("doc_id = 1").count() == 2 and single.where("text is null or text = ''").count() == 1
    assert single.where("doc_id is null and text is not null").count() == 1
    clean = stages["benchmark decontamination"](spark, docs, sf)
    assert clean.count() == len(rows) and "nobody" not in clean.where("doc_id = 7").first()["text"]
    assert ids(clean.where("doc_id is null or doc_id <> 7")) == ids(docs.where("doc_id is null or doc_id <> 7"))
    packed = c.run(spark, sf)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    assert c.run(spark, _corpus(spark, tmp_path, [])).count() == 0
