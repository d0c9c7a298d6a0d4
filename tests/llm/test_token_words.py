"""Words that are no stem and marks go to the tokenizers library many at a time."""

import pyarrow as pa

from furrow.llm import queries, token_ids

ODD = ["é", "a1$$$", "x\ny\nz", "ß.&&&", "<|endoftext|>", "a<|endoftext|>", "<|endoftext|>.", "Ġ", " ", "12,345", "🙂x", "a b", "(578)", "it's", "'s", "a\x00b", "​"]


def encoder(special_as_text):
    return token_ids.Encoder(queries.tokenizer_path(), special_as_text)


def test_words_in_a_row():
    for special_as_text in (False, True):
        enc = encoder(special_as_text)
        words = [w for w in ODD if not w.isspace()] + [f"w{i}$$" for i in range(2000)]
        ids, lens = enc._words(words)
        want = enc._whole([" " + w for w in words])
        assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_cuts_that_do_not_fit_are_not_used():
    enc = encoder(False)
    want = enc._whole([" " + w for w in ODD[:4]])
    enc.opens[want[1][-1]] = True  # as if a later id of a word opened with a space
    ids, lens = enc._words(ODD[:4])
    assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_texts_and_calls(monkeypatch):
    enc, given = encoder(False), []
    real = enc._whole
    monkeypatch.setattr(enc, "_whole", lambda texts: given.extend(texts) or real(texts))
    texts = ["", " ", "  a b", "a  b ", "a b\n", "one", None or "x", *[" ".join(["first", w, "and.\nThen", w + "!", "last,"]) for w in ODD],
             " ".join(["go", *[f"w{i}$$" for i in range(3000)]])]
    for _ in range(2):  # the second time all units are known
        ids, lens = enc.encode(pa.array(texts))
        want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert len(given) < 300  # one by one they were more than 3000
    ids, lens = enc.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and len(lens) == 0


def test_counts_over_slices(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_TOKENS", 4)
    rows = [(1, [5, 7, 5]), (2, [70_000, 5]), (3, [2]), (4, [7] * 20)]
    wide = {1: 2, 2: 4, 3: 2, 4: 4}
    data = [(d, len(v), bytearray(b"".join(i.to_bytes(wide[d], "little") for i in v))) for d, v in rows]
    out = token_ids.rank_table(spark.createDataFrame(data, "doc_id long, n_tokens long, ids binary").coalesce(1))
    assert {r.id: r.n for r in out.collect()} == {2: 1, 5: 3, 7: 21, 70_000: 1}
