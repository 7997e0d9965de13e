"""BPE, token attribution, secrets, toxicity, decontamination and tool calls."""

import hashlib
import json
import math
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bm25_decontaminate, bpe_tree, credential_grammar, subword_toxicity, token_attribution, tool_calls
from tests.oracle import assert_same

RANKS_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.read_ranks(RANKS_PATH), special_tokens={})


def test_bpe_round_trip(docs, texts, odd, empty, encoding):
    found = {r["doc_id"]: r for r in bpe_tree.bpe_digest(docs, RANKS_PATH, public_tokenizers.PATTERN).collect()}
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    whole = bpe_tree.bpe_round_trip(docs, RANKS_PATH, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in whole} == {i: t or "" for i, t in texts}
    want = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()), key=repr)
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in bpe_tree.bpe_round_trip(odd, RANKS_PATH, public_tokenizers.PATTERN).collect()), key=repr) == want
    assert bpe_tree.bpe_digest(empty, RANKS_PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(("chars", "size"), [(1, 1), (3, 2), (7, 3), (50, 16), (64, 16), (5000, 16)])
def test_tree_joins(encoding, chars, size):
    tree = bpe_tree.TreeEncoder(bpe_tree.read_ranks(RANKS_PATH), public_tokenizers.PATTERN, chars, size)
    rng = random.Random(chars)
    for _ in range(250):
        text = "".join(rng.choice(["a", "th", "e", " ", "  ", "\n", "'re", "'l", "l", "12", "é", "漢", "!", "--", "'s", "in"]) for _ in range(rng.randint(0, 60)))
        text += "".join(rng.choice("abcdeth") for _ in range(rng.choice([0, 0, 90])))
        packed = tree.encode(text)
        assert packed == array("I", encoding.encode_ordinary(text)).tobytes()
        assert tree.decode(packed) == text.encode()


def test_token_attribution(docs, texts, odd, empty, encoding):
    rng = random.Random(2)
    cuts = {i: sorted({0, len(t or ""), *(rng.randint(0, len(t or "")) for _ in range(4))}) for i, t in texts}
    rows = [(i, [(a, b) for a, b in zip(c[:-1], c[1:], strict=True)][1:]) for i, c in cuts.items()]
    parts = docs.sparkSession.createDataFrame(rows, "doc_id long, parts array<struct<start:long,end:long>>")
    found = token_attribution.section_tokens(docs.join(parts, "doc_id"), RANKS_PATH, public_tokenizers.PATTERN, "parts").collect()
    got = {(r["doc_id"], r["section"]): r["n_tokens_largest"] for r in found}
    want = {}
    for i, t in texts:
        if not t:
            continue
        sections = dict(rows)[i]
        want |= {(i, k): 0 for k in range(len(sections))}
        raw, at = t.encode(), 0
        for token in encoding.encode_ordinary(t):
            size = len(encoding.decode_single_token_bytes(token))
            start = len(raw[:at].decode(errors="ignore"))
            end = len(raw[: at + size].decode(errors="ignore")) + (raw[at + size : at + size + 1] != b"" and raw[at + size] & 0xC0 == 0x80)
            overlaps = [(min(b, end) - max(a, start), -k) for k, (a, b) in enumerate(sections)]
            best = max(overlaps, default=(0, 0))
            key = (i, -best[1] if best[0] > 0 else None)
            want[key] = want.get(key, 0) + 1
            at += size
    assert got == want
    assert any(r["n_crossing"] for r in found)
    lines = token_attribution.section_tokens(odd, RANKS_PATH, public_tokenizers.PATTERN, rules=("first", "last"))
    assert lines.columns == ["doc_id", "section", "start", "end", "n_crossing", "n_tokens_first", "n_tokens_last"]
    n = len(encoding.encode_ordinary("same text here"))
    ids = {"another": len(encoding.encode_ordinary("another")), "SAME text here": len(encoding.encode_ordinary("SAME text here"))}
    want = [(None, 14, n), (1, 14, n), (1, 14, n), (1, 7, ids["another"]), (2, 14, ids["SAME text here"])]
    assert sorted(map(tuple, lines.collect()), key=repr) == sorted(((i, 0, 0, end, 0, k, k) for i, end, k in want), key=repr)
    assert token_attribution.section_tokens(empty, RANKS_PATH, public_tokenizers.PATTERN).count() == 0


def test_allocation_rules():
    start, end = np.array([0, 4]), np.array([4, 8])
    tokens = np.array([0, 3, 2, 5]), np.array([3, 6, 6, 9])
    assert token_attribution.allocate(*tokens, start, end).tolist() == [0, 1, 0, 1]
    assert token_attribution.allocate(*tokens, start, end, "first").tolist() == [0, 0, 0, 1]
    assert token_attribution.allocate(*tokens, start, end, "last").tolist() == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        token_attribution.section_tokens(None, "", "", rules=("middle",))


def test_crossing_is_counted_where_it_reaches(spark, encoding):
    # One token " banana" over three sections and a gap, then a token within one.
    df = spark.createDataFrame([(1, " banana x", [(0, 2), (2, 3), (4, 9)])], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    assert len(encoding.encode_ordinary(" banana x")) == 2
    found = sorted(token_attribution.section_tokens(df, RANKS_PATH, public_tokenizers.PATTERN, "parts", ("first", "largest", "last")).collect())
    assert [tuple(r)[1:] for r in found] == [(0, 0, 2, 1, 1, 0, 0), (1, 2, 3, 1, 0, 0, 0), (2, 4, 9, 1, 1, 2, 2)]


def test_sections_in_any_state(spark, encoding):
    """Null, negative, reversed, overlapping, empty and unordered sections, and ones past the end."""
    text = "one two three four five six"
    given = [None, (20, 400), (None, 3), (-5, 7), (4, 13), (9, None), (13, 13), (30, 40), (18, 15), (0, 2)]
    rows = [(1, text, given), (2, text, None), (3, text, []), (4, "", given), (5, None, given)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:long,end:long>>")
    assert (list(map(list, token_attribution.in_order([{"start": a, "end": b} for a, b in (x or (None, None) for x in given)], len(text))))) == [[9, 3, 4, 6, 8, 1, 7], [0, 2, 7, 13, 18, 20, 27], [2, 7, 13, 13, 18, 27, 27]]
    found = token_attribution.section_tokens(df, RANKS_PATH, public_tokenizers.PATTERN, "parts", ("first", "last")).collect()
    n = len(encoding.encode_ordinary(text))
    for doc in (1, 2, 3):
        own = [r for r in found if r["doc_id"] == doc]
        assert sum(r["n_tokens_first"] for r in own) == sum(r["n_tokens_last"] for r in own) == n
    assert {r["section"] for r in found if r["doc_id"] == 2} == {None}
    of_one = {r["section"]: tuple(r)[2:] for r in found if r["doc_id"] == 1}
    # " four" starts outside, " two" and " three" are in section 4, "one" crosses from 9 to 3.
    assert set(of_one) == {None, 9, 3, 4, 6, 8, 1, 7}
    assert of_one[9][2:] == (1, 1, 0) and of_one[3][2:] == (1, 1, 2) and of_one[4][3:] == (1, 1)
    assert all(of_one[k][2:] == (0, 0, 0) for k in (6, 8, 7))
    assert not [r for r in found if r["doc_id"] > 3]


LONG = {
    "blanks": " " * 1_000_000,
    "blanks and a word": " " * 300_000 + "x" + " " * 300_001 + "end",
    "signs": "%" * 300_000,
    "one letter": "a" * 400_000,
    "letters": "".join(random.Random(3).choice("abcdefgh") for _ in range(200_000)),
    "digits": "7" * 300_000,
    "lines": ("\n" + " " * 999) * 200,
}


@pytest.mark.parametrize("name", LONG)
def test_long_runs(encoding, name):
    """Runs of a million characters; the library encodes those of one match as one piece."""
    text, tree = LONG[name], bpe_tree.TreeEncoder(bpe_tree.read_ranks(RANKS_PATH), public_tokenizers.PATTERN)
    packed = tree.encode(text)
    assert tree.decode(packed) == text.encode()
    pieces = [" " * 299_999, " x", " " * 300_000, " end"] if name == "blanks and a word" else [text]
    assert packed == array("I", [i for p in pieces for i in encoding._encode_single_piece(p)]).tobytes()
    spans = token_attribution.OffsetEncoder(tree).spans(text)
    assert spans[0][0] == 0 and spans[1][-1] == len(text) and (spans[0][1:] == spans[1][:-1]).all()


def test_long_runs_in_tables(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(LONG.values())], "doc_id long, text string")
    found = token_attribution.section_tokens(df, RANKS_PATH, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens_largest").alias("n")).collect()
    coded = {r["doc_id"]: r["n_tokens"] for r in bpe_tree.bpe_digest(df, RANKS_PATH, public_tokenizers.PATTERN).collect()}
    assert {r["doc_id"]: r["n"] for r in found} == coded


SECRETS = [
    (1, "x token = 'abcdefgh1' and PASSWORD:short api-key api_key:AAAA1111bbbb"),
    (2, "AKIAABCDEFGHIJKL AKIA123 " + "0123456789abcdef" * 2 + " deadbeef"),
    (3, "é token=api_key:longer_than_eight"),
    (4, None),
    (5, ""),
    (6, "ſecret = abcdefghijkl"),
]


def test_base_spans(spark, odd, empty):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string")
    found = {r["doc_id"]: r for r in credential_grammar.scan(df).collect()}
    base = {1: "assign:2:20,assign:49:69", 2: "access:0:16,hex:25:57", 3: "", 4: "", 5: "", 6: ""}
    for i, listed in base.items():
        assert found[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), i
        assert [s for s in found[i]["spans"].split(",") if "format" not in s] == listed.split(",")
    assert (found[1]["n_assign"], found[2]["n_access"], found[2]["n_hex"]) == (2, 1, 1)
    assert credential_grammar.scan(odd).count() == 8
    assert credential_grammar.scan(empty).count() == 0


def base_model(text):
    """Base spans by the letter: leftmost matches, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found)


def test_base_law_over_a_table(spark, sf_dir, docs, odd):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(4)
    pieces = ["password", "PASSWD", "api_key", "apikey", "Token", "secret", '"', "'", " ", "=", ":", "AKIA", "ABCDEF012345", "abcdef0123456789", "longvalue.x-1", "é", "ſ", "\n", "."]
    made = spark.createDataFrame([(10_000 + i, "".join(rng.choices(pieces, k=30))) for i in range(400)], "doc_id long, text string")
    rows = table.union(made).union(docs.select("doc_id", "text")).union(odd.select("doc_id", "text"))
    names, want = ("assign", "access", "hex"), []
    for r in rows.collect():
        found = base_model(r["text"] or "")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)
        want.append((r["doc_id"], *(sum(k == x for _, k, _ in found) for x in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed))
    got = []
    for r in credential_grammar.scan(rows).collect():
        base = ",".join(s for s in r["spans"].split(",") if "_format" not in s)
        got.append((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], base))
        starts = [(int(s.split(":")[1]), (*names, *credential_grammar.LEARNED).index(s.split(":")[0])) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 50 and sum(w[2] for w in want) > 20 and sum(w[3] for w in want) > 20


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_long_credentials_teach_their_format():
    rng = random.Random(8)
    long = lambda n=180: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    formats = credential_grammar.learn({"hex": [long() for _ in range(300)], "plain": ["andering", "restatement", "under_the_mill", "thth.ere"] * 10})
    found = [formats.classify(long()) == 2 for _ in range(60)] + [formats.classify(long().upper()) == 2 for _ in range(20)]
    assert sum(found) > 0.95 * len(found)
    assert formats.classify("x" * 180) is None and formats.classify(long()[:-1] + "zz") is None
    # One that is larger than all that may be held makes room for the others.
    some = [long(40) for _ in range(9)]
    assert credential_grammar.bounded(["a" * (1 << 18), *some]) == some


def test_planted_formats():
    """Precision and recall on credentials of the learned formats among tokens that look a little like them."""
    rng = random.Random(1)
    fresh = lambda chars, n, head="": head + "".join(rng.choice(chars) for _ in range(n))
    word = lambda: "".join(rng.choice(["the", "er", "tion", "ing", "and", "keit", "ou", "men"]) for _ in range(rng.randint(2, 6)))
    digest, key = lambda: fresh("0123456789abcdef", 40), lambda: fresh(LETTERS[:26] + LETTERS[52:], 16, "AKIA")
    values = [lambda: fresh(LETTERS, 24), lambda: fresh(LETTERS, 28, "sk-"), lambda: f"{fresh(LETTERS, 12)}.{fresh(LETTERS, 20)}.{fresh(LETTERS, 16)}"]
    others = [lambda: fresh("0123456789", 16), lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4)), lambda: f"555-{fresh('0123456789', 4)}", word, lambda: "/".join(word() for _ in range(3)), lambda: f"20{rng.randint(10, 26)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"]
    samples = {"assign": [rng.choice(values)() for _ in range(300)], "access": [key() for _ in range(300)], "hex": [digest() for _ in range(130)], "plain": [word() for _ in range(300)]}
    automaton = credential_grammar.Automaton(samples["hex"])
    assert len(automaton.red) == 41 and [k for k, e in enumerate(automaton.end) if e > -math.inf] == [automaton.red.index(max(automaton.red))]
    formats = credential_grammar.learn(samples)
    secrets = [(make(), kinds) for make, kinds in ((digest, {0, 2}), (lambda: digest().upper(), {0, 2}), (key, {1}), *((v, {0}) for v in values)) for _ in range(100)]
    found = [formats.classify(t) in kinds for t, kinds in secrets]
    false = [t for make in others for t in (make() for _ in range(200)) if len(t) >= 8 and formats.classify(t) is not None]
    assert sum(found) >= 0.95 * len(secrets)
    assert len(false) <= 0.01 * sum(found), false
    # Lengths that no credential of a format has.
    assert not any(formats.classify(t) is not None for _ in range(50) for t in (fresh("0123456789ABCDEF", 16), fresh("0123456789ABCDEF", 41), key() + "A", fresh(LETTERS, 100)))
    assert credential_grammar.learn({}).classify("0" * 40) is None


def test_formats_of_any_length_have_loops():
    rng = random.Random(2)
    sample = []
    for _ in range(300):
        text = "x" + rng.choice("ab")
        while rng.random() < 0.9:
            text += rng.choice("ab")
        sample.append(text[:100])
    automaton = credential_grammar.Automaton(sample)
    assert len(automaton.red) < 12
    assert automaton.likelihood("x" + "ab" * 40) > automaton.likelihood("x" + "bc" * 40) and automaton.likelihood("x" + "ab" * 40) > -2


def test_every_candidate_is_scored():
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice(LETTERS[:26] + LETTERS[52:]) for _ in range(n))
    sizes = [10, 40, 100]
    samples = {"assign": [fresh(sizes[k % 3]) for k in range(300)], "plain": ["".join(rng.choice(["the", "er", "tion", "ing"]) for _ in range(4)) for _ in range(300)]}
    formats = credential_grammar.learn(samples)
    for n in sizes:
        token = fresh(n)
        assert credential_grammar.all_spans(f"the andering {token}, mill {token}.", formats) == ([], [(13, 3, 13 + n), (20 + n, 3, 20 + 2 * n)]), token
    # All symbols count, also those after the longest remembered token.
    assert credential_grammar.REMEMBERED_CHARS < 100
    assert formats.classify(fresh(100)) == 0 and formats.classify(fresh(72) + "therandingtion" * 2) is None
    # Whole runs without an upper bound, none where a base find is.
    text = "a.b/" + "x" * 5000 + " seven77 eight888 token=abcdefgh1 done"
    assert [m.group() for m in credential_grammar.candidates(text, credential_grammar.base_spans(text))] == ["a.b/" + "x" * 5000, "eight888"]


def test_toxicity_on_held_out(spark, sf_dir):
    from tests.oracle import connection

    rows = connection("/root/testdata/sf0.01").sql("SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)").fetchall()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in subword_toxicity.toxicity(docs, subword_toxicity.fit(docs, labels)).collect()}
    for i, _, _ in rows:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= found[i]["score"] <= 1 and found[i]["predicted"] == int(found[i]["score"] >= 0.5)
    held = [(found[i]["score"], y) for i, _, y in rows if found[i]["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y > z]
    assert np.mean(pairs) > 0.85


def test_subwords_share_vectors():
    rng = random.Random(5)
    clean = ["river", "stone", "mill", "wheel", "gate", "boat", "field"]
    docs, labels = [], []
    for k in range(400):
        words = rng.choices(clean, k=30)
        if k % 4 == 0:
            words[rng.randint(0, 29)] = "disgusting"
        docs.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    scorer = subword_toxicity.Scorer(subword_toxicity.Trainer(docs, np.array(labels)).train())
    good, bad, misspelt, none = scorer.scores(["river stone mill", "river disgusting mill", "river disgustingg mill", ""])
    assert bad > 0.5 and misspelt > 0.5 and good < 0.5 and none < 0.5


def plain_score(text, model):
    """The score by its definition, n-gram by n-gram."""
    mask, words = (1 << 64) - 1, []
    for w in re.findall(r"\w+", text.lower()):
        if not words or words[-1] != w:
            words.append(w)
    means = []
    for w in words:
        marked, weights = f"<{w}>", []
        for n in subword_toxicity.SIZES:
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) & mask
                weights.append(model.weights[((h + n) * 0x9E3779B97F4A7C15 & mask) >> (64 - subword_toxicity.BITS)])
        means.append(float(np.mean(weights)) if weights else 0.0)
    k, n = subword_toxicity.WINDOW, len(words)
    starts = {*range(0, max(1, n - k + 1), k // 2), max(0, n - k)}
    top = max((sum(means[i : i + k]) / k for i in starts), default=0.0) if n else 0.0
    return 1 / (1 + math.exp(-(top + model.bias)))


def test_scores_by_definition(docs, texts, odd):
    rng = np.random.default_rng(3)
    model = subword_toxicity.Model(rng.normal(0, 3, 1 << subword_toxicity.BITS).astype(np.float32), -1.5)
    want = {i: plain_score(t or "", model) for i, t in texts}
    found = {r["doc_id"]: r for r in subword_toxicity.toxicity(docs, model).collect()}
    assert {i: r["score"] for i, r in found.items()} == pytest.approx(want, abs=1e-5)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found.values()) and len({r["predicted"] for r in found.values()}) == 2
    rows = sorted(((r["doc_id"], r["held_out"], round(r["score"], 4)) for r in subword_toxicity.toxicity(odd, model).collect()), key=repr)
    assert rows == sorted(((r["doc_id"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, round(plain_score(r["text"] or "", model), 4)) for r in odd.collect()), key=repr)


def test_long_labelled_texts_teach(spark):
    rng = random.Random(9)
    clean = ["river", "stone", "mill", "wheel", "gate", "boat", "field", "corn", "hill"]
    rows = [(i, " ".join(rng.choice([*clean, "disgusting"] if i % 2 else clean) for _ in range(9000))) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for _, t in rows) > subword_toxicity.TRAIN_CHARS
    model = subword_toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert [r["predicted"] for r in subword_toxicity.toxicity(df, model).orderBy("doc_id").collect()] == [i % 2 for i, _ in rows]


def test_drop_toxic_by_row(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, "vile words here" if i % 2 else "quiet mill here", None, None, None) for i in range(200)] + [(None, "vile words here", None, None, None), (500, "vile words", None, None, None)]
    odd = odd.withColumn("doc_id", F.col("doc_id") + 1000)  # without labels
    kept = subword_toxicity.drop_toxic(spark.createDataFrame(rows, odd.schema).union(odd), labels)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(i, t) for i, t, *_ in rows if t.startswith("quiet")] + [(r["doc_id"], r["text"]) for r in odd.collect()], key=repr)


def test_toxicity_edges(docs, odd, empty, texts):
    constant = subword_toxicity.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    found = subword_toxicity.toxicity(docs, constant).collect()
    assert len(found) == len(texts) and not any(r["predicted"] for r in found)
    assert subword_toxicity.toxicity(odd, constant).count() == 8
    assert subword_toxicity.toxicity(empty, subword_toxicity.fit(empty, empty.select("doc_id", F.lit(1).alias("toxic")))).count() == 0
    kept = subword_toxicity.drop_toxic(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert kept.columns == docs.columns and kept.count() == len(texts)


ITEMS = [(i, f"What number follows {i} in the row of item{i} stones and item{i} gates by the river{i}? The answer{i} is number{i + 1} for sure.") for i in range(30)]


def test_leaks(spark, docs, texts, odd, empty):
    rng = random.Random(6)
    filler = [t for _, t in texts if t]
    rows, planted = [], set()
    for k in range(60):
        text = rng.choice(filler)[:3000]
        if k % 3 == 0:
            item = ITEMS[k % 30]
            words = item[1].split()
            if k % 2:
                words[4] = "changed"
            text, planted = f"{text} {' '.join(words).upper()} {text}", planted | {(k, item[0])}
        if k % 3 == 1:
            text += " " + ITEMS[k % 30][1].split("?")[0]
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([*ITEMS, (None, "x"), (99, None), ITEMS[0]], "item_id long, text string")
    found = bm25_decontaminate.leaked_items(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    kept = bm25_decontaminate.drop_leaks(df, items)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in planted}
    assert bm25_decontaminate.leaked_items(odd, items).count() == 0
    assert bm25_decontaminate.leaked_items(empty, items).count() == 0
    assert bm25_decontaminate.leaked_items(df, items.limit(0)).count() == 0
    assert bm25_decontaminate.drop_leaks(docs, items.limit(0)).count() == len(texts)


def test_leaks_under_null_and_repeated_ids(spark):
    rows = [(None, ITEMS[0][1]), (None, "clean words of no item at all"), (None, None), (5, ITEMS[3][1]), (5, "other words, clean as well"), (5, ITEMS[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in bm25_decontaminate.leaked_items(df, items).collect()} == {(None, ITEMS[0][0]), (5, ITEMS[3][0])}
    assert sorted((tuple(r) for r in bm25_decontaminate.drop_leaks(df, items).collect()), key=repr) == sorted([rows[1], rows[2], rows[4]], key=repr)


def test_several_indexes(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    parts = bm25_decontaminate.indexes(items, 1000)
    assert len(parts) > 1 and sum(len(p.items) for p in parts) == len(ITEMS)


def test_indexes_share_weights(spark):
    rows = [*ITEMS, (30, "stones " * 80 + "and gates")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    weights = lambda index: {(w, index.items[k][0]): x for w, i in index.term.items() for k, x in zip(index.items_of.lists()[i], index.items_of.lists("weight")[i], strict=True)}
    whole, parts = bm25_decontaminate.Index(rows), bm25_decontaminate.indexes(items, 1000)
    assert len(parts) > 1 and {p.stride for p in parts} == {whole.stride}
    assert {k: x for p in parts for k, x in weights(p).items()} == pytest.approx(weights(whole))
    docs = spark.createDataFrame([(k, f"first {t} last") for k, t in ITEMS[:8]] + [(8, "nothing")], "doc_id long, text string")
    pairs = {(r["doc_id"], r["item_id"]) for r in bm25_decontaminate.leaked_items(docs, items, 1000).collect()}
    assert pairs == {(k, k) for k in range(8)}
    assert [r["doc_id"] for r in bm25_decontaminate.drop_leaks(docs, items, 1000).collect()] == [8]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_words():
    rng = random.Random(5)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(1, 25)) for _ in range(2))
        hit = bm25_decontaminate.in_order(a, b)
        kept, rest = [w for w, h in zip(a, hit, strict=True) if h], iter(b)
        assert len(kept) == lcs(a, b) and all(w in rest for w in kept)


def test_items_without_spaces():
    rng = random.Random(6)
    item = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(40)) + "\u3002" + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20)) + "\u3002"
    filler = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(500))
    index = bm25_decontaminate.Index([(1, item), *ITEMS[1:]])
    bare = item.replace("\u3002", "")
    assert [i for _, i, *_ in index.leaks([filler + bare + filler, filler, filler + bare[:30] + filler])] == [1]


def test_no_single_word_is_the_answer():
    item = " ".join(f"word{k}" for k in range(30)) + " doez. Ñ."
    index = bm25_decontaminate.Index([(1, item), *ITEMS[1:]])
    assert [i for _, i, *_ in index.leaks([item, item.removesuffix(" Ñ."), "word1 word2"])] == [1, 1]
    # All but 17 of 100 words, the last sentence among them.
    words = [f"word{k}" for k in range(99)]
    index = bm25_decontaminate.Index([(1, " ".join(words) + ". end."), *ITEMS[1:]])
    assert [i for _, i, *_ in index.leaks([" ".join(words[:80]) + " end", " ".join(words[:83]), " ".join(words)])] == [1, 1]
    for n in range(60):
        words, cuts = bm25_decontaminate.splits(" ".join(["a"] * (n - 1)) + ". b." if n > 1 else "b" * n)
        assert len(words) == n and n - cuts[1] >= -(-n // 4) and cuts[1] <= cuts[0] <= n


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.6])
def test_retrieval_is_complete(threshold):
    index = bm25_decontaminate.Index(ITEMS)
    rng = random.Random(7)
    passages = [sorted(rng.sample(range(len(index.term)), 12)) for _ in range(80)] + [[index.term[w] for w in {*bm25_decontaminate.words_of(ITEMS[3][1])}]]
    flat = [(k, t) for k, p in enumerate(passages) for t in p]
    got = index.retrieve(np.array([k for k, _ in flat]), np.array([t for _, t in flat]), threshold)
    lists, weights = index.items_of.lists(), index.items_of.lists("weight")
    want = set()
    for k, p in enumerate(passages):
        scores = np.zeros(len(index.items))
        for t in p:
            scores[lists[t]] += weights[t]
        want |= {(k, int(i)) for i in np.nonzero(scores >= threshold)[0]}
    assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_tool_calls(spark):
    calls = [
        (1, "b", "a", "f", '{"z": 1, "a": "x"}'), (1, "a", None, "f", '{"a": 5}'), (1, "c", "b", "g", "{"), (1, "c", "b", "g", "{"), (2, "a", "zz", "f", None),
        (3, "p", "q", "f", '{"a": "1"}'), (3, "q", "p", "f", '{"a": "1", "q": 0}'), (None, "x", None, "f", "{}"), (4, None, None, "f", "{}"),
    ]
    results = [(1, "a", 'say "hi"\n'), (1, "b", None), (9, "z", "lost"), (1, "a", 'say "hi"\n')]
    tools = [("f", [("a", "string", True), ("z", "integer", False)])]
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, name string, arguments string").withColumn("level", F.lit("clash"))
    results = spark.createDataFrame(results, "conv_id long, call_id string, content string").withColumn("r", F.lit("clash"))
    tools = spark.createDataFrame(tools, "name string, params array<struct<key:string,type:string,required:boolean>>")
    found = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(calls, results, tools).collect()}
    assert len(found) == 7
    assert {k: (r["status"], r["level"], r["errors"]) for k, r in found.items()} == {
        (1, "a"): ("linked", 0, "type:a"), (1, "b"): ("linked", 1, ""), (1, "c"): ("pending", 2, "tool"), (2, "a"): ("pending", 0, "json"),
        (3, "p"): ("pending", None, ""), (3, "q"): ("pending", None, "unknown:q"), (9, "z"): ("orphan", None, None),
    }
    assert found[(1, "b")]["message"] == '{"arguments":{"a":"x","z":1},"id":"b","name":"f","result":null}'
    assert found[(1, "a")]["message"] == '{"arguments":{"a":5},"id":"a","name":"f","result":"say \\"hi\\"\\n"}'
    assert {k: (r["n_repeats"], r["position"]) for k, r in found.items() if k[0] == 1} == {(1, "a"): (0, 0), (1, "b"): (0, 1), (1, "c"): (1, 2)}
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), tools).count() == 0


def test_canonical_numbers(spark):
    pairs = {
        '{"a":1e2}': '{"a":100}', '{"a":100}': '{"a":100}', '{"a":100.0}': '{"a":100}', '{"b":-0.0,"a":1.50e-3}': '{"a":0.0015,"b":0}', '{"a":123456789012345678901234567890123456789012}': '{"a":1.23456789012345678901234567890123456789012e41}',
        '{"a":12345678901234567890.5}': '{"a":12345678901234567890.5}', '{"a":[1E+3, 2.10 ,"3.0e1"]}': '{"a":[1000,2.1,"3.0e1"]}', '{"s":"x \\"5\\" 6","n":7}': '{"n":7,"s":"x \\"5\\" 6"}',
        '{"s":"\\\\","n":[true,null,{}]}': '{"n":[true,null,{}],"s":"\\\\"}', '{"s":"\\u00015","t":"\\\\u00015"}': '{"s":"\\u00015","t":"\\\\u00015"}', '{"a":1e-7}': '{"a":1e-7}', '{"a":1e400}': '{"a":1e400}', "5": "5", '"5"': '"5"', "{": None, "01": None,
    }
    df = spark.createDataFrame([(k,) for k in pairs], "j string")
    assert {r["j"]: r["c"] for r in df.select("j", tool_calls.canonical(tool_calls.marked(F.col("j"))).alias("c")).collect()} == pairs
    long = '{"text":"' + "a\\\\ \\n 7" * 50_000 + '","n":1.0}'
    got = spark.createDataFrame([(long,)], "j string").select(tool_calls.canonical(tool_calls.marked(F.col("j"))).alias("c")).first()["c"]
    assert got == '{"n":1,' + long[1:-9] + "}"


def test_schemas(spark):
    params = [("where", "object", True, None), ("where.city", "string", True, None), ("where.zip", "integer", False, None), ("tags", "array<string>", False, None), ("unit", "string", False, ['"m"', '"km"']), ("n", "integer", False, ["1", "2"]), ("x.y", "number", True, None), ("any", "date", False, None)]
    cases = {
        '{"where":{"city":"a","zip":12345678901234567890123},"tags":["p"],"unit":"m","n":1.0,"x":{"y":0.5},"any":[1]}': "",
        '{"where":{"zip":1.5},"tags":["p",1],"unit":"ft","n":3}': "choice:n,choice:unit,missing:where.city,type:tags,type:where.zip",
        '{"where":"a","tags":"p","x":{},"other":1}': "missing:x.y,type:tags,type:where,unknown:other",
        "[1]": "json",
        "7": "json",
        '{"n":1,"n":2}': "json",
        '{"x":{"y":1,"y":2}}': "json",
    }
    calls = spark.createDataFrame([(1, str(k), None, "f", text) for k, text in enumerate(cases)], "conv_id long, call_id string, parent_id string, name string, arguments string")
    tools = spark.createDataFrame([("f", params)], f"name string, params {tool_calls.PARAMS}")
    found = tool_calls.link_tool_calls(calls, calls.limit(0).select("conv_id", "call_id", F.lit("").alias("content")), tools).orderBy("call_id").collect()
    assert [r["errors"] for r in found] == list(cases.values())
    assert [r["position"] for r in found] == list(range(len(cases)))
    assert json.loads(found[5]["message"])["arguments"] == '{"n":1,"n":2}'


def test_order_of_a_large_conversation(spark):
    rng = random.Random(3)
    rows = [(1, f"c{k:04}", f"c{rng.randrange(k):04}" if k % 7 else None) for k in range(1, 3000)] + [(2, "x", "y"), (2, "y", "x"), (2, "z", None), (3, "q", "q")]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string").repartition(5)
    found = tool_calls.positions(tool_calls.levels(df)).collect()
    place = {(r["conv_id"], r["call_id"]): r["position"] for r in found}
    for conv in (1, 2, 3):
        own = [r for r in found if r["conv_id"] == conv]
        want = sorted(own, key=lambda r: (r["level"] is None, r["level"] or 0, r["call_id"]))
        assert [r["position"] for r in want] == list(range(len(own)))
    assert all(place[c, p] < place[c, i] for c, i, p in rows if p and c == 1 and (c, p) in place)
    assert place[2, "z"] == 0


def test_long_chains(spark):
    calls = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("parent_id"))
    assert all(r["level"] == int(r["call_id"]) for r in tool_calls.levels(calls).collect())


def test_queries_against_sql(spark, sf_dir):
    from millrace.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), sql, sf_dir)
