import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from tidemark.llm import sentencepiece_codec as S

PATH = P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", " a ", "a  b", "▁a", "a▁▁b ▁", "a\tb\n c", "é ﬁ", "a\x00b", "\U00010348x ☃", "　 x", "<s> a", "</s><unk>", " \n \n", "x" * 3000, "ab " * 2000, " " * 300, "café naïve  \U0001f600\U0001f600"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_chunks_give_the_librarys_ids_and_text(library):
    run = S.codec(S.read_model(PATH), most_chunks=50)
    assert S.splits_at_markers(library)
    rng = random.Random(1)
    alphabet = "ab ▁\t\né中\U0001f600.,0 "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for text in texts:
        ids = library.encode(text or "")
        assert run(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids)), repr(text)


def test_query_columns_and_defined_cases(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "a", "x", "y"), (0, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    got = S.digests(df, PATH).collect()
    assert len(got) == len(rows)
    want = []
    for row in rows:
        ids = library.encode(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    full = {r.doc_id: r for r in S.encode(df.where("doc_id > 0"), PATH).collect()}
    assert full[4].ids == library.encode("a") and full[8].decoded == "a  b"
    assert S.digests(df.limit(0), PATH).collect() == []
