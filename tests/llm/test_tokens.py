"""BPE, token counts, language, fingerprints, near duplicates, decontamination, the pipeline."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import bpe, decontaminate, language, nearcopies, phrases, registry, simhash, tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")


def random_texts(seed, n, longest=60):
    r = random.Random(seed)
    letters = "  \n\t'\"abcdefstleraéßñ中文日1234!?.<|>\x1c\x85　​😀Ᲊ\U000323b0"
    return ["".join(r.choices(letters, k=r.randint(0, longest))) for _ in range(n)]


# --- BPE ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def tables():
    return bpe.tables_at(bpe.default_path())


def test_codec_against_the_library(library, tables):
    texts = [*random_texts(1, 5000), "", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " " * 3000, "a" * 3000, "ab" * 2000, "\n" * 500 + "x", "don't we'll I'M"]
    codec = bpe.Codec(tables)
    for text, ids, wanted in zip(texts, codec.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == wanted.ids, text
        assert tables.speller.decode(ids).decode("utf-8", "replace") == library.decode(wanted.ids, skip_special_tokens=False)


def test_some_words_pass_the_test_and_some_are_repaired(tables):
    words = [w.encode() for w in (" the", " onwhstereation", "lynthatble", "zzzzqqqq", " erthtionndouanea")]
    ranks, counts, failed = tables.encode_words(words)
    assert 0 < failed < len(words)
    ends = np.cumsum(counts)
    for word, end, n in zip(words, ends, counts, strict=True):
        assert ranks[end - n : end].tolist() == tables.exact([word])[0] == tables.merged_long(word)


def test_pair_test_is_what_merging_two_tokens_gives(tables):
    r = np.random.default_rng(5)
    a, b = r.integers(0, tables.n, 4000), r.integers(0, tables.n, 4000)
    whole = [tables.exact([bytes(tables.speller.decode(tables.ids[[x, y]]))])[0] == [x, y] for x, y in zip(a, b, strict=True)]
    assert tables.compatible(a, b).tolist() == whole


def test_any_ids_decode_as_the_library_does(library, tables):
    r = random.Random(6)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert tables.speller.decode(np.array(ids, np.uint32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_a_full_cache_is_dropped(tables, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    codec, texts = bpe.Codec(tables), random_texts(7, 50)
    first = [codec.encode([t])[0].tolist() for t in texts]
    assert first == [x.tolist() for x in bpe.Codec(tables).encode(texts)] and len(codec.slots) < 60


def test_round_trip_on_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "x " * 100_000), (4, "y" * 20_000), (None, "no id"), (6, "same"), (6, "same")]
    got = bpe.digests(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(bpe.pack(ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(frame(spark, [])).count() == 0
    both = bpe.decode(bpe.encode(frame(spark, rows)), drop_ids=False).collect()
    assert sorted(r["decoded"] for r in both) == sorted(t or "" for _, t in rows)


# --- token counts --------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_count_like_the_whole(name, monkeypatch):
    counter = tokencount.Counter(public_tokenizers.path(name))
    texts = [*random_texts(8, 400, 300), *(" ".join(random.Random(i).choices(["a", "b1", "cde", "f.", "  g", "x\ny"], k=200)) for i in range(40))]
    monkeypatch.setattr(tokencount, "LONG", 30)
    monkeypatch.setattr(tokencount.parts, "__defaults__", (30,))
    monkeypatch.setattr(tokencount, "BATCH_BYTES", 500)
    assert counter.count(texts) == [n for t in texts for n in counter.lengths([t])]


def test_token_counts_on_edges(spark):
    from sentencepiece import SentencePieceProcessor

    s = SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.VOCABULARY))
    rows = [(1, None), (2, ""), (3, "word é " * 30_000), (4, "y" * 50_000), (None, "no id"), (6, "same"), (6, "same")]
    got = tokencount.count_tokens(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((i or 0, len((t or "").encode()), n := len(s.encode(t or "")), n > 4096) for i, t in rows)
    assert tokencount.count_tokens(frame(spark, [])).count() == 0


# --- language --------------------------------------------------------------------------------
WORDS = {"en": "the of and to in is that it for was with", "fr": "le la les de un une des et est que qui dans", "de": "der die das und ist nicht ein eine mit von zu"}


def sentence(r, lang, n):
    return " ".join(r.choices(WORDS[lang].split(), k=n))


def test_held_out_texts(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    train, held = [d for d in docs if d["doc_id"] % 2], [d for d in docs if d["doc_id"] % 2 == 0]
    model = language.fit([(d["lang"], d["text"]) for d in train])
    scores = language.log_likelihoods([d["text"] for d in held], model)
    right = [model.languages[k] == d["lang"] for k, d in zip(scores.argmax(1), held, strict=True)]
    assert np.mean(right) > 0.98


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")


def test_evidence_is_fused(spark):
    r = random.Random(9)
    rows = [(i, sentence(r, "de" if i % 2 else "fr", 30), "de" if i % 2 else "fr", "de.example" if i % 2 else "fr.example", "example") for i in range(200)]
    # without letters there is no text evidence; what little there is leaves host and declaration to decide
    rows += [(1000, "a", "de", "de.example", "example"), (1001, "a", None, "fr.example", "example"), (1002, "123 456", "de", "de.example", "example"), (1003, None, "de", "de.example", None)]
    got = {x["id"]: x for x in language.identify(rows_of(spark, rows)).collect()}
    assert all(got[i]["language"] == ("de" if i % 2 else "fr") and not got[i]["rejected"] for i in range(200))
    assert got[1000]["language"] == "de" and got[1001]["language"] == "fr"
    assert got[1002]["rejected"] and got[1003]["language"] == "und"


def test_priors_against_plain_sums(spark):
    r = random.Random(10)
    rows = [(i, sentence(r, r.choice(list(WORDS)), 8), r.choice([None, "en", "fr"]), r.choice(["a", "b", None]), r.choice(["x", None])) for i in range(60)]
    model = language.train(rows_of(spark, rows))
    scored = language.scored(rows_of(spark, rows), model, drop_text=True)
    table, base, _ = language.priors(scored, model)
    post = language.normalised(language.log_likelihoods([t for _, t, *_ in rows], model))
    corpus = post.sum(0)
    flat = (corpus + 1) / (corpus.sum() + len(corpus))
    assert np.allclose(np.exp(base), flat, atol=1e-4)
    for x in table.collect():
        host, suffix = x["host_"], x["suffix__"]
        of = lambda pick: post[[pick(q) for q in rows]].sum(0)
        s = of(lambda q: q[4] == suffix)
        q = flat if suffix is None else (s + language.SUFFIX_MASS * flat) / (s.sum() + language.SUFFIX_MASS)
        h = of(lambda y: y[3] == host and y[4] == suffix)
        want = q if host is None else (h + language.HOST_MASS * q) / (h.sum() + language.HOST_MASS)
        assert np.allclose(np.exp(x["prior"]), want, atol=1e-4)


def test_scores_depend_on_no_neighbour():
    model = language.fit([(k, v * 20) for k, v in WORDS.items()])
    texts = ["", "la", "der und", "", "x", "of the"]
    together = language.log_likelihoods(texts, model)
    assert all(np.allclose(language.log_likelihoods([t], model)[0], row) for t, row in zip(texts, together, strict=True)) and not together[0].any()


def test_fused_posterior_against_plain_python(spark):
    r = random.Random(21)
    declared = lambda: r.choice([None, "en", "FR", "de-AT", "xx", "not a tag"])
    rows = [(i, " ".join(r.choices([w for v in WORDS.values() for w in v.split()], k=r.randint(0, 4))), declared(), r.choice(["a", "b", None]), r.choice(["x", "y", None])) for i in range(300)]
    model = language.fit([(k, v * 20) for k, v in WORDS.items()])
    got = {x["id"]: x for x in language.identify(rows_of(spark, rows).withColumn("scores", F.lit("kept")).withColumn("prior", F.lit(1)), model=model).collect()}
    names, n = model.languages, len(model.languages)
    tag = lambda d: {"en": "en", "FR": "fr", "de-AT": "de", "xx": "xx"}.get(d)
    like = language.log_likelihoods([t for _, t, *_ in rows], model)
    post = language.normalised(like)
    corpus = post.sum(0)
    base = (corpus + 1) / (corpus.sum() + n)
    of = lambda pick: post[[bool(pick(x)) for x in rows]].sum(0)
    for k, (i, text, d, host, suffix) in enumerate(rows):
        q, s = base, of(lambda x: x[4] == suffix)
        if suffix is not None:
            q = (s + language.SUFFIX_MASS * base) / (s.sum() + language.SUFFIX_MASS)
        h = of(lambda x: x[3] == host and x[4] == suffix)
        prior = q if host is None else (h + language.HOST_MASS * q) / (h.sum() + language.HOST_MASS)
        logs = like[k] + np.log(prior)
        if tag(d) in names:
            said = of(lambda x: tag(x[2]) == tag(d))
            logs = logs + np.log((said + language.DECLARED_MASS * ((np.array(names) == tag(d)) * 0.9 + 0.1 / n)) / (corpus + language.DECLARED_MASS))
        p = language.normalised(logs[None])[0]
        told = text != "" and p[:-1].sum() >= language.SURE
        want = names[int(p[:-1].argmax())] if told else "xx" if text and d == "xx" else "und"
        assert got[i]["scores"] == "kept" and (got[i]["language"] == want or abs(np.sort(p[:-1])[-1] - np.sort(p[:-1])[-2]) < 1e-3 or abs(p[:-1].sum() - language.SURE) < 1e-3), (rows[k], want, got[i], p)
        assert got[i]["rejected"] == (got[i]["language"] == "und")
        if told and got[i]["language"] == want:
            assert abs(got[i]["posterior"] - p[:-1].max()) < 1e-3


def test_languages_too_rare_to_model_are_kept(spark):
    r = random.Random(22)
    docs = spark.createDataFrame([(i, sentence(r, "en", 20), "en-GB", "s", 0) for i in range(60)] + [(100, "ҖҚӨ ӨҰҮҖ ҚҮҰ " * 9, "tlh", "s", 0), (101, "ҖҚӨ ӨҰҮҖ ҚҮҰ " * 9, "und", "s", 0)], DOCS)
    assert sorted(x["doc_id"] for x in language.keep_identified(docs).collect()) == [*range(60), 100]


def test_language_on_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the of and " * 50_000, "en", "s", 0), (None, sentence(random.Random(1), "en", 20), None, None, None), (5, "the cat and the dog", "en", "s", 1), (5, "the cat and the dog", "en", "s", 1)], DOCS)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 5, 5]
    assert language.keep_identified(docs.filter("false")).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------
def test_equal_substrings_are_cut_alike():
    r = random.Random(11)
    middle = "".join(r.choices("abcdefg hij", k=600))
    seen = []
    for pad in (0, 1, 7, 50):
        text = "".join(r.choices("abcdefg hij", k=pad)) + middle + "".join(r.choices("abcdefg hij", k=20))
        names, first = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint32), np.array([0])
        for _ in range(3):
            names, first = phrases.phrases(names, first)
        seen.append(set(names.tolist()))
    inner = set.intersection(*seen)
    assert len(inner) >= 0.6 * max(map(len, seen))


def test_sketches_dont_depend_on_neighbours():
    texts = [t for t in random_texts(12, 200, 200)]
    together = phrases.sketches(texts)
    assert all((phrases.sketches([t])[0] == row).all() for t, row in zip(texts, together, strict=True))


def test_likeness_follows_the_shared_part():
    r = random.Random(13)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    a, b = (" ".join(word() for _ in range(2000)) for _ in range(2))
    like = [float(phrases.likeness(*(phrases.sketches([x]) for x in (a, a[: int(len(a) * s)] + b[int(len(a) * s) :])))[0]) for s in (0, 0.5, 0.9, 1)]
    assert like[0] < 0.1 < 0.35 < like[1] < 0.65 < 0.75 < like[2] < like[3] == 1
    assert phrases.likeness(phrases.sketches([""]), phrases.sketches([""]))[0] == 1


def compared(rows):
    """What compare_with_edits gives, in plain Python."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own, changed, other = (phrases.sketches([x]) for x in (text, new, after))
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), phrases.spelled(own[0]), phrases.spelled(changed[0]), round(float(phrases.likeness(own, changed)[0]), 9), round(float(phrases.likeness(own, other)[0]), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_edits_against_brute_force(spark, parts):
    r = random.Random(14)
    rows = [(r.randint(0, 10**6), t) for t in random_texts(15, 80, 300)] + [(None, "no id"), (5, None), (5, ""), (7, "same"), (7, "same"), (9, "z" * 40_000)]
    got = phrases.compare_with_edits(frame(spark, rows).repartition(parts)).collect()
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=str) == compared(rows)


def test_edits_of_few_rows(spark):
    assert phrases.compare_with_edits(frame(spark, [])).count() == 0
    assert [tuple(r)[:2] for r in phrases.compare_with_edits(frame(spark, [(1, "abc")])).collect()] == [(1, 3)]


# --- near duplicates ----------------------------------------------------------------------------------
def brute_fingerprint(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_against_brute_force():
    texts = [*random_texts(16, 300, 200), None, "", " \t", "one", "one two", "A b C d", "x y z " * 1000, "İ K É"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    long = " ".join(str(i % 977) for i in range(5000))
    assert simhash.fingerprint(long, chunk=700) == brute_fingerprint(long)


def test_links_and_components_against_brute_force(spark):
    r = random.Random(17)
    prints = []
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 9)):
            prints.append(f)
            for b in r.sample(range(64), r.randint(0, 3)):
                f ^= 1 << b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = {signed(p): p for p in prints}
    nodes = spark.createDataFrame([(s,) for s in distinct], "fingerprint long")
    pairs = simhash.links(nodes)
    assert simhash.spread(nodes).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all((distinct[x["a"]] ^ distinct[x["b"]]).bit_count() <= 2 for x in pairs.collect())
    got = {x["node"]: x["root"] for x in simhash.components(pairs).collect()}
    assert {s: got.get(s, s) for s in distinct} == brute_components(distinct)


def test_a_long_chain_is_one_component(spark):
    chain = [(1 << i) - 1 for i in range(63)]
    pairs = simhash.links(spark.createDataFrame([(x,) for x in chain], "fingerprint long"))
    assert {x["root"] for x in simhash.components(pairs).collect()} == {0}


def test_near_duplicates_on_edges(spark):
    rows = [(9, None), (4, ""), (7, " \n"), (11, "a b c d e " * 30_000), (2, "a b c d e " * 30_000), (None, "lone words here"), (6, "same text is here"), (6, "same text is here"), (None, "")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(9, 4), (4, 4), (7, 4), (None, 4), (11, 2), (2, 2), (None, None), (6, 6), (6, 6)], key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def one_of_each_by_brute_force(rows, linked):
    """The (id, text) that stay, each once: of linked rows the one with the least id, null last, then the least hash of the text."""
    rows = sorted(set(rows), key=str)
    root = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if linked(a, b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return rows, root


@pytest.mark.parametrize("find", ["bits", "words"])
def test_one_of_each_against_brute_force(spark, find):
    many = "the quick brown fox jumps over the lazy dog and runs away from all of the others at once today"
    rows = [(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "something else altogether is here"), (3, "one text that nothing resembles"), (None, "a text without any id"), (None, many), (8, many), (None, "null id one"), (None, "null id two"), (None, "null id one")]
    rows += [(2, None), (1, ""), (1, None), (6, "same same same"), (6, "same same same"), (7, many), (9, "alpha beta gamma delta")]
    def prints(t):
        return brute_fingerprint(t)

    near = {"bits": lambda a, b: (prints(a) ^ prints(b)).bit_count() <= 2, "words": lambda a, b: (a or "").split() == (b or "").split()}[find]
    told, root = one_of_each_by_brute_force(rows, near)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("root", F.lit(1)).withColumn("print", F.lit("x"))
    kept = simhash.one_of_each(docs) if find == "bits" else simhash.one_of_each(docs, nearcopies.near_copies(docs))
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # each group keeps one row, one with its least id
    groups = {}
    for r, row in zip(root, told, strict=True):
        groups.setdefault(r, []).append(row)
    assert len(got) == len(set(got)) == len(groups)
    for members in groups.values():
        stay = [x for x in members if x in got]
        assert len(stay) == 1 and (stay[0][0] is None) == all(i is None for i, _ in members)
        assert stay[0][0] is None or stay[0][0] == min(i for i, _ in members if i is not None)
    assert simhash.one_of_each(docs.filter("false")).count() == 0


def jaccard_components(texts):
    """The least id of the component of each id, by all pairs."""
    def cut(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("few", [nearcopies.FEW, 2])
def test_near_copies_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(nearcopies, "FEW", few)
    r = random.Random(23)
    texts = {}
    for _ in range(12):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([3, 8, 60, 200, 600]))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 5]) * len(base) // 200):
                copy[r.randrange(len(copy))] = "other"
            texts[len(texts)] = " ".join(copy)
    wanted = jaccard_components(texts)
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(frame(spark, list(texts.items()))).collect()}
    assert got == wanted and len(set(wanted.values())) < len(texts)


def test_copies_that_only_resemble_their_source(spark, monkeypatch):
    """Large groups whose members link through one text, and groups that share a key but no link."""
    monkeypatch.setattr(nearcopies, "FEW", 3)
    r = random.Random(29)
    texts = {}
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(400)]
        texts[len(texts)] = " ".join(base)
        for _ in range(25):
            copy = list(base)
            for at in r.sample(range(0, 400, 5), 8 + g):
                copy[at] = f"x{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    wanted = jaccard_components(texts)
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(frame(spark, list(texts.items()))).collect()}
    assert got == wanted


def test_near_dedup_stage_takes_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = jaccard_components({d["doc_id"]: d["text"] or "" for d in docs.collect()})
    kept = {d["doc_id"] for d in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == set(wanted.values())


def test_near_copies_on_edges(spark):
    rows = [(9, None), (4, ""), (7, " \n"), (None, "lone words here"), (6, "same text is here"), (6, "same text is here"), (None, "")]
    got = [(r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(9, 4), (4, 4), (7, 4), (None, 4), (None, None), (6, 6), (6, 6)], key=str)
    assert nearcopies.near_copies(frame(spark, [])).count() == 0


# --- decontamination --------------------------------------------------------------------------------------
def norm(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def contaminated_by_brute_force(text, item):
    d, q = norm(text), norm(item)
    if not q:
        return False
    width = min(len(q), decontaminate.WINDOW)
    for diagonal in range(-len(q) + 1, len(d)):
        agree = [0 <= diagonal + j < len(d) and d[diagonal + j] == q[j] for j in range(len(q))]
        if any(sum(agree[i : i + width]) >= -(-decontaminate.SHARE * width // 1) for i in range(len(q) - width + 1)):
            return True
    return False


def test_contamination_against_brute_force(spark):
    r = random.Random(18)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([4, 5, 6, 8, 13, 20, 40, 40, 1, 2, 3])] + [(90, None), (91, "")]
    docs, planted = [], set()
    for i in range(120):
        body = r.choices(words, k=r.randint(0, 80))
        if i % 2:
            item, text = r.choice(items[:11])
            part = text.split()
            kept = part if len(part) < 30 or r.random() < 0.5 else part[: len(part) // 2]
            # up to as many words as are allowed are others, anywhere
            width = min(13, len(kept))
            others = r.sample(range(len(kept)), r.randint(0, width - -(-4 * width // 5))) if len(kept) == len(part) else []
            part = [w if j not in others else "other" for j, w in enumerate(kept)]
            at = r.randint(0, len(body))
            body[at:at] = part
            planted.add((i, item))
        docs.append((i, r.choice([" ", ", ", "\n"]).join(body).title()))
    wanted = {(i, j) for i, t in docs for j, q in items if q and contaminated_by_brute_force(t, q)}
    assert planted <= wanted
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["id"], x["item_id"]) for x in decontaminate.contaminated(frame(spark, docs), benchmark).collect()}
    assert got == wanted


def test_every_accepted_placement_is_found(spark):
    from itertools import combinations

    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        assert decontaminate.least_hits(n, [*decontaminate.MASKS, *(decontaminate.MASKS_OF_5 if n == 5 else ())]) >= 1
    items, docs = [], []
    for n in [*range(5, 14), 20]:
        words = [f"q{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        width = min(n, 13)
        allowed = width - -(-decontaminate.SHARE * width // 1)
        for others in combinations(range(width), int(allowed)):
            changed = ["other" if i in others or i >= width else w for i, w in enumerate(words)]
            docs.append((len(docs), "so it was " + " ".join(changed) + " as they say"))
            docs.append((len(docs), " ".join(changed).removeprefix("other ").removesuffix(" other")))
            # one more word changed
            more = next(i for i in range(width) if i not in others)
            docs.append((len(docs), "so it was " + " ".join("other" if i == more else w for i, w in enumerate(changed)) + " as they say"))
    wanted = {(i, j) for i, t in docs for j, q in items if contaminated_by_brute_force(t, q)}
    got = {(x["id"], x["item_id"]) for x in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == wanted and len(wanted) >= 2 * len(docs) // 3


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    r = random.Random(19)
    items = [(i, " ".join(f"v{r.randint(0, 300)}" for _ in range(25))) for i in range(6)]
    docs = [(i, "intro " + items[i % 6][1] + " outro" if i % 3 else "clean text of many words " * 5) for i in range(30)]
    run = lambda: sorted(tuple(x) for x in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).select("id", "item_id", "matched").collect())
    first = run()
    monkeypatch.setattr(decontaminate, "small_enough", lambda *a: False)
    assert run() == first and len(first) == 20


def test_repeated_rows_each_give_a_row(spark):
    text = "so it was one two three four five six one two three four five six again"
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (1, "three four"), (2, "again"), (3, "six seven"), (None, "so it was one two")], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, [(4, text), (4, text), (4, "again"), (None, "three four"), (None, "three four")]), benchmark).collect()
    assert sorted(((x["id"], x["item_id"], x["item_words"]) for x in got), key=str) == sorted([(4, 1, 6), (4, 1, 2), (4, 2, 1), (4, None, 5)] * 2 + [(4, 2, 1), (None, 1, 2), (None, 1, 2)], key=str)


def test_decontamination_on_edges(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "e", "s", 0), (2, "", "e", "s", 0), (3, "pad " * 100_000 + "One two THREE four, five six seven eight nine ten!", "e", "s", 0), (None, "one two three four five six seven eight nine ten", "e", "s", 0), (5, "clean", "e", "s", 0), (5, "clean", "e", "s", 0)], DOCS)
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 5]
    assert decontaminate.decontaminate(docs.filter("false"), benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.filter("false")).count() == 6


# --- pipeline and registry -----------------------------------------------------------------------------------
def test_pipeline_against_its_stages_in_plain_python(spark, sf):
    from marginalia.llm import secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # language: no document of these is rejected, as all are in modelled languages
    components = jaccard_components({d["doc_id"]: d["text"] or "" for d in docs})
    kept = [d for d in docs if components[d["doc_id"]] == d["doc_id"]]
    seeds = [{" ".join(norm(q)[i : i + 3]) for i in range(len(norm(q)) - 2)} for q in items]

    def clean(d):
        x = norm(d["text"])
        grams = {" ".join(w) for w in zip(x, x[1:], x[2:])}
        return not any(grams & s and contaminated_by_brute_force(d["text"], q) for s, q in zip(seeds, items, strict=True))

    kept = [d for d in kept if clean(d)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for d in kept:
        (_, spans), = secrets.scan_texts([d["text"]], secrets.trained())
        text = secrets.blanked(d["text"], spans)
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((d["doc_id"], len(ids), hashlib.sha256(bpe.pack(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert len(corpus_pipeline.STAGES) == 5


def test_registry_has_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_queries_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    for name, sql in registry.ORACLE_SQL.items():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        got = registry.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(names)
        rows = sorted((tuple(r) for r in got.select(*names).collect()), key=str)
        assert rows == sorted(want.fetchall(), key=str) and rows, name


def test_pages_and_documents_are_identified(spark, sf):
    df = registry.QUERIES["op6_language_id"](spark, sf)
    got = df.groupBy("kind").agg(F.count("*"), F.count_if("rejected")).collect()
    assert {r[0]: r[1] for r in got} == {"document": 200, "page": 50} and not any(r[2] for r in got)
