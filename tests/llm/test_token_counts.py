import gzip

import numpy as np
import public_tokenizers
import pytest
from edges import documents, nothing
from tokenizers import Tokenizer

from refreshgate.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("block_tokens", [1, 3, 7, 1000])
@pytest.mark.parametrize("width, packed", [(2, False), (4, False), (2, True)])
def test_blocks_are_stitched(spark, tmp_path, block_tokens, width, packed):
    rng, want = np.random.default_rng(1), []
    for shard in range(3):
        docs = [rng.integers(0, 50000, rng.integers(0, 25)) for _ in range(30)]
        files = [docs[:13], docs[13:]]
        for number, own in enumerate(files):
            data = b"".join(d.astype(f"<u{width}").tobytes() + (50256).to_bytes(width, "little") for d in own)
            if shard == 1 and number == 1:
                data += np.arange(5, dtype=f"<u{width}").tobytes()
                docs.append(np.arange(5))
            if packed:  # as two members, the first of which ends anywhere
                data = gzip.compress(data[:len(data) // 3]) + gzip.compress(data[len(data) // 3:])
            (tmp_path / f"part-0000{shard}-x-c00{number}.txt{'.gz' * packed}").write_bytes(data)
        want += [(shard, k, len(d)) for k, d in enumerate(docs)]
    (tmp_path / "part-00007-x-c000.txt").write_bytes(b"")
    found = token_counts.count_tokens(spark, str(tmp_path), width=width, block_tokens=block_tokens)
    assert sorted(map(tuple, found.collect())) == want


def test_documents(spark, tmp_path):
    spark.createDataFrame(documents(spark).collect(), documents(spark).schema).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = token_counts.document_counts(docs, str(tmp_path / "tokens"), PATH)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    want = [(r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    nothing(spark).write.parquet(str(tmp_path / "none"))
    assert token_counts.document_counts(spark.read.parquet(str(tmp_path / "none")), str(tmp_path / "no-tokens"), PATH).count() == 0


def test_a_compressed_file_that_ends_early(spark, tmp_path):
    (tmp_path / "part-00000-x-c000.txt.gz").write_bytes(gzip.compress(bytes(range(256)) * 40)[:-20])
    with pytest.raises(Exception, match="ends early"):
        token_counts.count_tokens(spark, str(tmp_path)).count()


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="need more than 1 bytes"):
        token_counts.write_token_files(documents(spark), str(tmp_path / "narrow"), PATH, end_id=200, width=1)
