"""Operators against plain versions, on a small table of odd documents: nulls, empty and long texts, ties, repeated rows and identifiers, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskspark.llm import chunk_store, exact_dedup, language_id, packing, pii, sentence_pieces, sharding, simhash, url_filter, weighted_sampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, body string, code int, unit string, block int, size int, rank int, copies int"
LONG = " ".join(f"word{k % 700} runs" for k in range(20_000))
STORY = "the old miller walked slowly over the bridge and counted every stone that the river had left there in the spring of a very long year"
TEXTS = [
    None, "", " ", "\n\t", "A", "a", "Hello World", "hello world", "hello  world", STORY, STORY.replace("miller", "baker"), STORY.upper(), LONG, LONG + " end",
    "Der alte Müller ging über die Brücke und zählte jeden Stein", "mail bob@example.com or 10.0.0.1, call +44 (0)20 7946 0958, card 4111 1111 1111 1111",
    "x" * 5000, "é" * 300, "12.345.6.7 1.2.3.4.5 a@b.c@d.e +1 2", "4111-1111-1111-1112 Dr. Anna Smith 078-05-1120", "😀 ok 😀", "▁a b", "hello world",
]


def rows():
    out = [(k * 7 % 101, t, ["en", "de", None][k % 3], "web" if k % 4 else None, 1, "d", 5, "b", 1, "u", 2, 3, 4, 9) for k, t in enumerate(TEXTS)]
    return out + [out[6], out[6], (out[9][0], "another text under an identifier seen before", *out[9][2:]), (None, "nobody's text", *out[0][2:]), (None, "nobody's text", *out[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


PLAIN = [(r[0], r[1] or "") for r in rows()]
TRANS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encoded():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, t.encode(x, add_special_tokens=False).ids + [2]) for i, x in PLAIN]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_returns_every_id(spark, docs, empty, tmp_path):
    chunk_store.write_store(docs, f"file://{tmp_path}/store")
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in chunk_store.read_sums(spark, f"file://{tmp_path}/store").collect())
    want = Counter((-1 if i is None else i, len(x), crc(x)) for i, x in encoded())
    assert Counter(g[1:] for g in got) == want
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0
    whole = {(r["start"], r["doc_id"]): r["ids"] for r in chunk_store.read_documents(spark, f"file://{tmp_path}/store").collect()}
    assert Counter((i if i is not None else -1, crc(x)) for (_, i), x in whole.items()) == Counter({(i, c): n for (i, _, c), n in want.items()})
    stored = spark.read.parquet(f"file://{tmp_path}/store/chunks")
    assert stored.count() == stored.select("digest").distinct().count()
    chunk_store.write_store(empty, f"file://{tmp_path}/none")
    assert chunk_store.read_sums(spark, f"file://{tmp_path}/none").count() == 0


def test_a_damaged_chunk_is_noticed(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    chunk_store.write_store(docs.limit(8), path)
    bad = spark.read.parquet(f"{path}/chunks").withColumn("ids", F.concat("ids", F.unhex(F.lit("01000000")))).cache()
    bad.count()
    bad.write.mode("overwrite").parquet(f"{path}/other")
    spark.read.parquet(f"{path}/other").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        chunk_store.read_sums(spark, path).collect()


@pytest.mark.parametrize("at_once", [1, 500, 1 << 20])
def test_documents_hashed_together_are_cut_as_alone(monkeypatch, at_once):
    monkeypatch.setattr(chunk_store, "CUT_IDS", at_once)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 70_000 if k == 4 else 49_000, n).astype("<u4") for k, n in enumerate((1, 63, 64, 65, 900, 5000, 1, 20_000, 1023, 1024, 1025, 3000))]
    alone = [(len(d), [chunk_store.packed(x) for x in np.split(d, chunk_store.cuts(d)[:-1])]) for d in docs]
    assert list(chunk_store.chunked([d.tobytes() for d in docs])) == alone
    assert list(chunk_store.chunked([])) == []


def test_words_with_marks_after_them_go_to_the_model():
    from riskspark.llm import wordbpe

    texts = ["mentoupa&&& Onth***", "haing,$$$ ERNDNDST,!! don't we' ab's it's' (x) a_b b__ x-- \u0131a.. 12,. end..... ab<|x|> \u00e9!!", "erlich\u00fc%%% a a. a.. ''s"]
    enc = wordbpe.Encoder(wordbpe.tokenizer_file("word_bpe_49k.json"))
    library, sent = enc.tokenizer, []

    class Seen:
        def encode_batch(self, words, **more):
            sent.extend(words)
            return library.encode_batch(words, **more)

        def encode(self, text, **more):
            return library.encode(text, **more)

    enc.tokenizer = Seen()
    assert enc.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert "don't" in sent and "end....." in sent and not {"mentoupa&&&", "Onth***", "haing,$$$", "ERNDNDST,!!", "erlich\u00fc%%%"} & set(sent)


def test_sentence_pieces_are_the_library_s(docs, empty):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = sentence_pieces.load()
    got = sentence_pieces.decode(sentence_pieces.encode(docs, pieces), pieces).collect()
    want = Counter((i, tuple(model.encode(x)), x.replace("▁", " ")) for i, x in PLAIN)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["text"]) for r in got) == want
    assert sentence_pieces.encode(empty, pieces).count() == 0


def test_space_runs_and_long_words_are_the_library_s(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" " * k + w for k in range(1, 50) for w in ("", "then", "9")] + ["ab" * 400, "thequickbrownfox" * 30, "a\0b<s><0x41>"]
    pieces = sentence_pieces.load()
    got = sentence_pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {k: model.encode(t) for k, t in enumerate(texts)}


def test_unigram_models_take_the_best_path(spark):
    table = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.0, "aba": -7.5, "▁": -2.0, "▁a": -4.2, "▁ab": -8.0}
    pieces = sentence_pieces.pieces_of(sentence_pieces.UNIGRAM, [(t, k, s) for k, (t, s) in enumerate(table.items())], [99] * 256, [t.encode() for t in table])
    units = ["▁abab", "▁baab", "ababab", "▁", "▁▁a", "b", "abc"]

    def best(u):
        paths = {0: (0.0, ())}
        for e in range(1, len(u) + 1):
            paths[e] = max((paths[s][0] + table.get(u[s:e], -18.0 if e == s + 1 else -1e9), paths[s][1] + (u[s:e],)) for s in range(e))
        return paths[len(u)][0]

    got = sentence_pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()
    for r in got:
        parts = [pieces.text[c] if c < sentence_pieces.ODD else chr(c - sentence_pieces.ODD) for c in r["codes"]]
        assert "".join(parts) == r["unit"] and abs(sum(table.get(p, -18.0) for p in parts) - best(r["unit"])) < 1e-9
    assert len(got) == len(units)


def plain_simhash(text, words_each=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(TRANS))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + words_each]) for k in range(len(words) - words_each + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_simhash_groups(docs, empty):
    fps = [plain_simhash(t) for _, t in PLAIN]
    comp = components([i for i, _ in PLAIN], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == Counter((i, f, c) for (i, _), f, c in zip(PLAIN, fps, comp))
    assert simhash.near_groups(empty).count() == 0


def test_simhash_links_every_near_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).tolist()
    fps = base + [b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base * 4] + [0, 1, 3, 7, 15, (1 << 64) - 1]
    fps = sorted({f % (1 << 64) for f in fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").withColumn("cell", simhash.embedding(F.col("fp")))
    edges = {(r["a"], r["b"]) for r in simhash.links(frame).collect()}
    place = {f: k for k, f in enumerate(signed)}
    made = {tuple(sorted((place[a], place[b]))) for a, b in edges}
    assert components(range(len(fps)), lambda i, j: (j, i) in made) == components(range(len(fps)), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)


def test_components_and_links_broadcast_no_growing_table(spark):
    """The tables of a graph are small as files and large as rows: broadcast, they fill the driver."""
    fps = spark.createDataFrame([(k, "t" + " w" * k) for k in range(40)], "doc_id long, text string")
    plan = simhash.near_groups(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    crowd = spark.createDataFrame([(k,) for k in range(1 << 10)], "fp long").withColumn("cell", simhash.embedding(F.col("fp")))
    plan = simhash.links(crowd)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_links_by_fingerprints_and_by_shingle_sets(spark):
    import corpus_pipeline

    long = "same line again and again " * 150
    texts = [long + " ".join(f"{c}{k}" for k in range(n)) for c, n in (("p", 220), ("q", 220))]  # few distinct shingles in common, one fingerprint for most
    base = [f"w{k}" for k in range(300)]
    texts += [" ".join(base), " ".join(base[:250]), "something else entirely, of seven words"]
    fps = [plain_simhash(t) for t in texts]
    bits = lambda i, j: bin(fps[i] ^ fps[j]).count("1")
    assert bits(0, 1) <= 2 and jaccard(*texts[:2]) < 0.5 and bits(2, 3) > 2 and jaccard(*texts[2:4]) >= 0.8
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()} == {0, 2, 4}


def test_near_copies_one_of_each_group_stays(docs, empty):
    def sims(t):
        words = t.translate(TRANS).split()
        return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [sims(t) for _, t in PLAIN]

    def linked(i, j):
        if not sets[i] or not sets[j]:
            return sets[i] == sets[j]
        return len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    groups = components(list(range(len(PLAIN))), linked)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    where = defaultdict(set)
    for (_, t), g in zip(PLAIN, groups):
        where[t].add(g)
    assert sorted(min(where[t]) for t in texts) == sorted(set(groups))
    assert simhash.drop_near_copies(empty).count() == 0


def shingled(t):
    words = t.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def one_of_each_is_kept(spark, texts):
    groups = components(list(range(len(texts))), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups))


def test_near_copies_edited_in_one_block_are_found(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: [f"w{int(x)}" for x in rng.integers(0, 3000, n)]
    texts = []
    for k in range(60):
        base = prose(300)
        cut = int(rng.integers(0, 250))
        near = (base + prose(70), base[:245], base[:cut] + prose(28) + base[cut + 28 :])[k % 3]
        texts += [" ".join(base), " ".join(near)]
        assert 0.8 <= jaccard(*texts[-2:]) < 0.86
    one_of_each_is_kept(spark, texts)


def test_edits_of_one_text_are_grouped_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)  # so that the last pairs lie in many blocks
    rng = np.random.default_rng(7)
    base, texts = [f"w{k}" for k in range(100)], []
    for k in range(120):
        edited = list(base)
        for n, at in enumerate(rng.integers(0, 100, int(rng.integers(1, 7)))):
            edited[at] = f"x{int(rng.integers(0, 4))}" if n % 2 else f"own{k}-{n}"
        texts.append(" ".join(edited))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert {r["doc_id"] for r in kept.collect()} == set(root)


def test_near_copies_among_texts_of_one_word_set_are_found(spark):
    rng = np.random.default_rng(6)
    words, texts = [f"w{k}" for k in range(400)], []
    for _ in range(60):
        base = [words[k] for k in rng.permutation(400)]
        near = base[:200] + [base[201], base[200]] + base[202:]
        texts += [" ".join(base), " ".join(near)]
    one_of_each_is_kept(spark, texts)


def test_a_large_group_with_pairs_on_both_sides_of_the_bound(spark):
    rng = np.random.default_rng(7)
    base, texts = [f"w{k}" for k in range(150)], []
    for k in range(120):
        edited = list(base)
        for at in rng.choice(150, int(rng.integers(1, 8)), replace=False):
            edited[at] = f"x{k}y{at}"
        texts.append(" ".join(edited))
    one_of_each_is_kept(spark, texts)


def test_edits_of_one_text_are_not_paired_all_with_all(spark, monkeypatch):
    """The text they are edits of is among them and connects those that can be near copies of any; most pairs are below the bound and need not be made."""
    made, blocks = [], simhash.in_blocks
    monkeypatch.setattr(simhash, "in_blocks", lambda pairs, found: made.append(pairs.count()) or blocks(pairs, found))
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(200):
        edited = list(base)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            edited[at] = f"x{k}y{at}"
        texts.append(" ".join(edited))
    one_of_each_is_kept(spark, texts)
    assert len(made) == 1 and made[0] < len(texts)


def test_a_chain_that_only_its_neighbours_link(spark):
    one_of_each_is_kept(spark, [" ".join(f"w{k}" for k in range(9 * s, 9 * s + 100)) for s in range(30)] + [" ".join(f"w{k}" for k in range(1000 + 15 * s, 1100 + 15 * s)) for s in range(8)])


@pytest.mark.parametrize("law_shards", [24, 3])
def test_shards(docs, empty, law_shards):
    got = sharding.assign_shards(docs, law_shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in PLAIN)
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(k, 0) for k in range(law_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(law_shards))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sharding.assign_shards(empty, law_shards).count() == 0


def test_hilbert_curve_visits_every_cell_by_steps_of_one():
    cells = [g.ravel() for g in np.meshgrid(*[np.arange(8)] * 3, indexing="ij")]
    order = np.argsort(sharding.hilbert_index(cells, 3))
    path = np.stack(cells, 1)[order]
    assert sorted(sharding.hilbert_index(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_language_by_rank_order(spark, docs, empty):
    model = language_id.learn(docs)
    got = language_id.with_language(docs, model)
    assert set(docs.columns) | {"lang_pred", "lang_score"} == set(got.columns)
    for r in got.collect():
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter) and 0 <= r["lang_score"] <= 1

    def ranking(texts):
        n = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                s = f" {w} "
                for k in (1, 2, 3):
                    n.update(s[i : i + k] for i in range(len(s) - k + 1))
        n.pop(" ", None)
        return n

    text = "und der alte Müller ging über die Brücke"
    grams, counts = language_id.gram_counts(text)
    plain = ranking([text])
    spelled = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF): n for c, n in zip(grams.tolist(), counts.tolist())}
    assert spelled == dict(plain)
    assert language_id.learn(empty) == [] and language_id.with_language(docs, []).where("lang_pred != 'und'").count() == 0


def test_languages_held_out(spark):
    got = language_id.op5_language_id(spark, "/root/testdata/sf0.001")
    told = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out AND lang_pred != 'und'").join(told, "doc_id").where("lang IS NOT NULL").collect()
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_other_languages_and_noise_are_dropped_and_short_texts_stay(spark):
    rng = np.random.default_rng(8)
    typed = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 10)))) for _ in range(60))
    strange = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
        "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler", typed, rng.bytes(400).hex(), "123 456",
    ]
    clean = ["Hello", "Hello world", "The cat sat on the mat.", "Water boils at one hundred degrees.", "Der Hund schläft.", "Guten Tag", "el perro come"]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-k - 1, t, None) for k, t in enumerate(strange + clean)], real.schema)
    kept = {r["doc_id"] for r in language_id.accept_language(real.unionByName(more)).select("doc_id").collect()}
    assert {k for k in kept if k < 0} == {-k - 1 for k in range(len(strange), len(strange + clean))}
    assert len(kept) - len(clean) == real.where("text RLIKE '\\\\p{L}'").count()


def test_sampling_collides_like_generalised_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(5):
        a, b = Counter(rng.integers(0, 60, 300).tolist()), Counter(rng.integers(20, 80, 200).tolist())
        exact = sum(min(a[x], b[x]) for x in a | b) / sum(max(a[x], b[x]) for x in a | b)
        s = weighted_sampling.Sampler()
        found = np.mean([weighted_sampling.likeness(s.fingerprint(" ".join(f"{k}w{x}" for x in a.elements())), s.fingerprint(" ".join(f"{k}w{x}" for x in b.elements()))) for k in range(20)])
        assert abs(found - exact) < 0.05


def mixed_one(x):
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return x ^ x >> 31


def plain_weighted_sample(text):
    """Each hash function's sample, a word and the step of its weight, term by term."""
    counts, out = Counter(text.split()), []
    for k in range(weighted_sampling.HASHES if counts else 0):
        found = []
        for w, n in counts.items():
            term = xxhash.xxh3_64_intdigest(w.encode())
            first = mixed_one(term ^ mixed_one(k))
            second, top = mixed_one(first), (1 << 64) - 1
            a, b, c, d, beta = (((h >> 40) + 0.5) / 2**24 for h in (first, first << 24 & top, second, second << 24 & top, second * 0x9E3779B97F4A7C15 & top ^ first))
            r, log_c = -math.log(a * b), math.log(-math.log(c * d))
            found.append((log_c - r * (math.floor(math.log(n) / r + beta) - beta) - r, term, math.floor(math.log(n) / r + beta)))
        _, term, step = min(found)
        out.append(mixed_one(mixed_one(term ^ mixed_one(k)) ^ mixed_one(step)) >> 48)
    return np.array(out or [0] * weighted_sampling.HASHES, "<u2").tobytes().hex()


def test_fingerprints_equal_plain_ones(docs, monkeypatch):
    monkeypatch.setattr(weighted_sampling, "RANGE_BYTES", 40_000)
    got = weighted_sampling.with_fingerprints(docs).collect()
    order = sorted(PLAIN, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, same = [], lambda f, g: sum(f[k : k + 4] == g[k : k + 4] for k in range(0, len(f), 4)) / weighted_sampling.HASHES
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        f, g, h = (plain_weighted_sample(x) for x in (t, t[: len(t) - len(t) // 2] + u[: len(t) // 2], u))
        want.append((i, f, g, same(f, g), same(f, h)))
    assert Counter(tuple(r[c] for c in ("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in got) == Counter(want)


def test_a_full_memo_changes_no_fingerprint(monkeypatch):
    monkeypatch.setattr(weighted_sampling, "MEMO_ROWS", 5000)
    texts = [" ".join(f"w{(k * j) % 9000}" for j in range(1500)) for k in range(1, 40)]
    small = weighted_sampling.Sampler()
    assert [small.fingerprint(t).tolist() for t in texts] == [weighted_sampling.Sampler().fingerprint(t).tolist() for t in texts]
    assert len(small.place) < 5000


def test_ranges_by_halving(spark):
    edges = [-5, 0, 3, 3, 9, 70]
    got = spark.createDataFrame([(x,) for x in range(-8, 80)], "x long").select("x", weighted_sampling.range_of(F.col("x"), edges).alias("k")).collect()
    assert all(r["k"] == sum(e <= r["x"] for e in edges) for r in got)


def test_fingerprints_of_edited_texts(docs, empty):
    got = weighted_sampling.with_fingerprints(docs).collect()
    order = sorted(PLAIN, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    assert len({r["fingerprint"] for r in got}) <= len({t for _, t in PLAIN}) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert weighted_sampling.with_fingerprints(empty).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?q", "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/", "https://a.b.net/es/x#f", "https://net/fr/", "x://y.org", "http://com", "http://com/", "http://a.com?x=/en/", "http://net/es//", "http://example.com/en/"]
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, prefix string")
    got = {r["page_id"]: r for r in url_filter.with_rule(pages, rules).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(TRANS)
        fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict), u
    assert len(got) == len(urls)
    assert url_filter.with_rule(pages, rules.limit(0)).where("verdict != 'allow'").count() == 0


def base_spans(t):
    out = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m[0])
            luhn = sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and luhn or kind == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_of_odd_and_real_texts(spark, docs, empty):
    found = Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["base"])) for r in pii.find_pii(docs).collect())
    assert found == Counter((i, tuple(base_spans(t))) for i, t in PLAIN)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in real.collect()}
    got = pii.find_pii(real).collect()
    assert {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in got} == {i: base_spans(t) for i, t in texts.items()}
    for r in got:
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    assert pii.find_pii(empty).count() == 0


def test_masking_takes_all_base_spans_out(docs):
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == len(PLAIN)
    assert not [s for r in out.collect() for s in base_spans(r["text"] or "") if s[1] < 2]


@pytest.mark.parametrize("window", [4096, 16])
def test_packing(docs, empty, window):
    got = packing.pack(docs, window=window).collect()
    pieces = Counter((i, s, crc(x[s : s + window]), len(x)) for i, x in encoded() for s in range(0, len(x), window))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= window
    assert packing.pack(empty, window=window).count() == 0


def test_fill_is_the_closest():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, 6)}
        chosen = packing.fill(counts, 40)
        sums = {max(counts)}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c - (n == max(counts)) + 1)}
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= 40) and all(k <= counts[n] for n, k in chosen.items())


def test_exact_groups(docs, empty):
    by = defaultdict(list)
    for i, t in PLAIN:
        by[t.translate(TRANS)].append(i)
    top = {t: max((x for x in v if x is not None), default=None) for t, v in by.items()}
    want = Counter((i, top[t.translate(TRANS)], len(by[t.translate(TRANS)]), hashlib.sha256(t.translate(TRANS).encode()).hexdigest()) for i, t in PLAIN)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(by)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["text"] or "").translate(TRANS) for r in kept.collect()) == Counter(by.keys())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_texts_of_one_digest_are_told_apart(spark, tmp_path):
    table = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "cd"), (4, "xyz"), (5, "cd"), (6, None)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", "largest", digest=lambda text: F.length(text).cast("string"))
    index.flush(table.limit(3))
    index.flush(table.where("doc_id > 3"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.groups(table).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True), 6: (6, 1, True)}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= before


CLASHING = ["row", "base", "proposed", "lang_pred", "lang_score", "_key", "_least", "_copies", "key", "id", "least", "node", "own", "crc", "shard", "spans", "masked", "a.b", "run", "copies", "digest"]


def with_clashes(docs):
    out = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, c in enumerate(CLASHING):
        out = out.withColumn(c, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return out


@pytest.mark.parametrize("stage", [language_id.accept_language, exact_dedup.drop_copies, simhash.drop_near_copies, pii.masked])
def test_stages_leave_columns_of_any_name(docs, empty, stage):
    rich = with_clashes(docs)
    got = stage(rich)
    assert got.columns == rich.columns and [f.dataType for f in got.schema] == [f.dataType for f in rich.schema]
    rows = got.collect()
    assert rows and all(r[c] == f"{k}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for k, c in enumerate(CLASHING))
    assert stage(with_clashes(empty)).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 27, 2000])
def test_shards_written_are_gapless_and_along_the_curve(docs, empty, tmp_path, monkeypatch, range_bytes):
    """Places in the files are those of a plain sort by the curve's number, identifier and crc."""
    monkeypatch.setattr(sharding, "RANGE_BYTES", range_bytes)
    sharding.write_shards(docs.withColumn("slot", F.lit("clash")), 4, f"file://{tmp_path}/s")
    spark = docs.sparkSession
    got = spark.read.parquet(f"file://{tmp_path}/s")
    assert set(got.columns) == {*docs.columns, "slot", "shard"}
    got = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows())
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    of = {name: [r[c] or "" for r in rows()] for name, c in (("_lang", 2), ("_source", 3))} | {"size": [len((r[1] or "").encode()) + 8 for r in rows()]}
    thin = docs.select(*sharding.metadata())
    cuts = sharding.cell_cuts(thin, sharding.STRINGS, sharding.NUMBERS)
    assert all(sorted(v) == v and set(v) <= set(of[c]) for c, v in cuts.items())
    curve = sharding.hilbert_index([np.array([sum(e <= v for e in cuts[c]) for v in of[c]]) for c in ("_lang", "_source", "size")], sharding.BITS)
    none = lambda i: -1 if i is None else i
    want = sorted((int(c), none(r[0]), zlib.crc32((r[1] or "").encode())) for c, r in zip(curve, rows()))
    found = [(none(r["doc_id"]), zlib.crc32((r["text"] or "").encode())) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert found == [w[1:] for w in want]
    sharding.write_shards(empty, 4, f"file://{tmp_path}/none")


def test_string_cells_tell_long_values_apart(spark):
    table = spark.createDataFrame([(k, "x", f"https://www.example.org/{k % 40:02d}", "en") for k in range(800)], "doc_id long, text string, source string, lang string").select(*sharding.metadata())
    cuts = sharding.cell_cuts(table, sharding.STRINGS, sharding.NUMBERS)
    assert len(set(cuts["_source"])) > 25 and cuts["_lang"] == ["en"] * 31


def test_a_reader_of_one_source_skips_most_shards(spark, tmp_path):
    """Least and largest values of the files rule out shards in each dimension."""
    rng = np.random.default_rng(3)
    table = [(k, "w" * int(rng.integers(1, 900)), f"common_crawl_{int(rng.integers(30)):02d}", "de en es fr".split()[int(rng.integers(4))]) for k in range(3000)]
    sharding.write_shards(spark.createDataFrame(table, "doc_id long, text string, source string, lang string"), 24, f"file://{tmp_path}/s")
    ends = spark.read.parquet(f"file://{tmp_path}/s").groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("lang").alias("c"), F.max("lang").alias("d")).collect()
    assert len(ends) == 24
    assert np.mean([sum(r["a"] <= f"common_crawl_{k:02d}" <= r["b"] for r in ends) for k in range(30)]) < 14
    assert np.mean([sum(r["c"] <= x <= r["d"] for r in ends) for x in ("de", "en", "es", "fr")]) < 16


def test_segment_counts_bound_the_bits_that_differ(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-(1 << 63), 1 << 63, 300)
    b = np.array([x ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 5)), replace=False)) for x in a.tolist()])
    pairs = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    got = pairs.select("a", "b", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("d")).collect()
    count = lambda x, k: bin((x & (1 << 64) - 1) >> 2 * k & 3).count("1")
    for r in got:
        assert r["d"] == sum(abs(count(r["a"], k) - count(r["b"], k)) for k in range(32)) <= bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1")


@pytest.mark.parametrize("dense", [1, 8, 1000])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(6)
    fps = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 20)}
    for x in list(fps):
        fps |= {x ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 63, (6, 2))} | {x ^ 0b11, x ^ 0b101, x ^ 0b1111}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").withColumn("cell", simhash.embedding(F.col("fp")))
    edges = [tuple(r) for r in simhash.links(nodes).collect()]
    assert all(a > b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    at = {x: k for k, x in enumerate(fps)}
    linked = {(at[a], at[b]) for a, b in edges}
    want = components(list(range(len(fps))), lambda i, j: bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2)
    assert components(list(range(len(fps))), lambda i, j: (i, j) in linked or (j, i) in linked) == want


def test_a_second_flush_joins_the_first(spark, docs, tmp_path):
    """The first batch's texts are gone when the second is flushed."""
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0 OR doc_id IS NULL")
    first.select("doc_id", "text").write.parquet(f"file://{tmp_path}/first")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", "largest")
    index.flush(spark.read.parquet(f"file://{tmp_path}/first"))
    index.compact()
    assert sum(map(len, index.levels)) == 1
    spark.read.parquet(f"file://{tmp_path}/first").limit(0).write.mode("append").parquet(f"file://{tmp_path}/first")
    index.flush(second)
    segment = {r["digest"]: (r["keep_id"], r["group_size"]) for r in index.compact().collect()}
    want = defaultdict(list)
    for i, t in PLAIN:
        want[hashlib.sha256(t.translate(TRANS).encode()).hexdigest()].append(i)
    assert segment == {d: (max((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items()}


def secrets(spark, n=240):
    rng = np.random.default_rng(7)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(n)]
    near = ['the token = "%s" is mine', 'his password: %s was read', 'see commit %s of the code', 'the md5 checksum %s fits', 'we saw %s there']
    return spark.createDataFrame([(k, near[k % 5] % h) for k, h in enumerate(hexes)], "doc_id long, text string")


def test_labelers_decide_on_proposed_spans(spark):
    docs = secrets(spark)
    got = {r["doc_id"]: len(r["spans"]) for r in pii.find_pii(docs).collect()}
    share = lambda found, k: np.mean([found[i] for i in found if i % 5 == k])
    assert share(got, 0) == share(got, 1) == 1 and share(got, 2) == share(got, 3) == 0
    without = {r["doc_id"]: len(r["spans"]) for r in pii.find_pii(docs, labelers=("shape", "gazetteer", "alone")).collect()}
    assert without != got


def test_supervision_equals_a_plain_version(spark, docs):
    found = pii.with_spans(docs.select("doc_id", "text").unionByName(secrets(spark)))
    spans = [s.asDict() for r in found.collect() for s in [*r["base"], *r["proposed"]]]
    pattern = lambda s: (s["kind"], *(s[v] for v in pii.VOTES))
    post = {pattern(s): min(0.95, max(0.05, 0.5 + 0.2 * sum(s[v] == 1 for v in pii.VOTES) - 0.5 * sum(s[v] == -1 for v in pii.VOTES))) for s in spans}
    for _ in range(50):  # over the spans themselves, not their counts
        new = {}
        for q in post:
            odds = math.log((1 + sum(post[pattern(s)] for s in spans if s["kind"] == q[0])) / (1 + 1e-9 + sum(1 - post[pattern(s)] for s in spans if s["kind"] == q[0])))
            for j, v in enumerate(pii.VOTES):
                yes, no = sum(post[pattern(s)] for s in spans), sum(1 - post[pattern(s)] for s in spans)
                odds += math.log((0.1 + sum(post[pattern(s)] for s in spans if s[v] == q[j + 1])) / (0.3 + yes) / ((0.1 + sum(1 - post[pattern(s)] for s in spans if s[v] == q[j + 1])) / (0.3 + no)))
            new[q] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        change, post = max(abs(new[q] - post[q]) for q in new), new
        if change < 1e-9:
            break
    model = pii.train(found)
    yes, no = 1 + sum(post[pattern(s)] for s in spans), 1 + sum(1 - post[pattern(s)] for s in spans)
    assert abs(model[""] - math.log(yes / no)) < 1e-6
    for f in pii.FEATURES:
        for value, got in model[f].items():
            a, b = 0.5 + sum(post[pattern(s)] for s in spans if s[f] == value), 0.5 + sum(1 - post[pattern(s)] for s in spans if s[f] == value)
            assert abs(got - math.log(a / yes / (b / no))) < 1e-6


def test_out_of_place_distances_equal_plain_ones(docs):
    model = language_id.learn(docs)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["lang_score"]) for r in language_id.with_language(docs, model).collect()}

    def grams(text):
        found, x = Counter(), "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        for n in (1, 2, 3):
            for k in range(len(x) - n + 1):
                g = x[k : k + n]
                if g.strip() and (n == 1 and g != " " or n == 2 or n == 3 and g[1] != " "):
                    found[g] += 1
        code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
        return [code(g) for g in sorted(found, key=lambda g: (-found[g], code(g)))[: language_id.PROFILE]]

    for (i, text), found in got.items():
        own = grams(text or "")
        if not own or not model:
            assert found == ("und", 0.0)
            continue
        far = {name: sum(abs(codes.tolist().index(g) - k) if g in codes else language_id.PROFILE for k, g in enumerate(own)) for name, codes in model}
        name = min(far, key=lambda n: (far[n], n))
        assert found[0] == name and abs(found[1] - (1 - far[name] / (language_id.PROFILE * len(own)))) < 1e-9
