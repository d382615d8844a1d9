"""Words that a polynomial hash can't tell apart are different words for every operator."""

import public_tokenizers
import pytest
import tokenizers

import brute
from fieldstone.llm import decontam, neardup, substring, token_counts, words
from test_operators import DOC, rows, same


def pair(n, letters="an"):
    """A Thue-Morse sequence of two letters and its complement."""
    a = "".join(letters[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans(letters, letters[::-1]))


def plain_rows():
    out = []
    for k, n in enumerate((1024, 2048)):
        a, b = pair(n)
        shared = " ".join(f"w{k}{i}" for i in range(12))
        out += [(10 * k + 1, f"{a} x{k} y z"), (10 * k + 2, f"{b} x{k} y z"), (10 * k + 3, f"{shared} {a}"), (10 * k + 4, f"{shared} {b}"), (10 * k + 5, f"{a} {b}")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in plain_rows()], DOC)


def test_near_duplicates(docs):
    same(rows(neardup.groups(docs), "doc_id", "n_shingles", "component_id", "kept"), brute.near_duplicates(plain_rows()))


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    same(rows(token_counts.count_tokens(docs, path), "doc_id", "n_tokens"), [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in plain_rows()])


def test_decontamination(docs, spark):
    items = [(k, pair(n)[k % 2]) for k, n in enumerate((1024, 2048))]
    got = decontam.report(docs, spark.createDataFrame(items, "item_id long, text string"))
    same(rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.decontaminate(plain_rows(), items))


def test_substring_dedup(docs):
    same(rows(substring.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring_dedup(plain_rows()))


@pytest.mark.parametrize("lost", [0, 0xFF])
def test_equal_hashes(monkeypatch, docs, spark, lost):
    """With hashes of 8 bits or none, pieces and benchmark words are still told apart by their bytes."""
    real = words.span_hashes
    weak = lambda *args: real(*args) & words.np.uint64(lost)
    for module in (token_counts, decontam, words):
        monkeypatch.setattr(module, "span_hashes", weak)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for _, t in plain_rows()] + ["Some plain words, and more of the same words.", "é 漢 x"]
    data = words.np.frombuffer("".join(texts).encode(), words.np.uint8)
    offsets = words.np.cumsum([0, *(len(t.encode()) for t in texts)])
    with open(path, "rb") as f:
        counts = token_counts.Counter(f.read()).counts(data, offsets)
    library = tokenizers.Tokenizer.from_file(path)
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    items = [(1, "plain words and more"), (2, pair(1024)[0]), (3, "of the same words")]
    windows = decontam.Windows(items)
    _, _, found = windows.hits(words.Block(data, offsets, words.ALNUM_WORDS, lower=True))
    want = brute.decontaminate(list(enumerate(texts)), items)
    assert [len(f) for f in found] == [w[3] for w in want] and sum(map(len, found)) > 2
