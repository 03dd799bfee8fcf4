"""What the dictionary of op2_suffix_dedup takes for equal."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import suffix_dedup, textkit


@pytest.mark.parametrize("byte", range(8))
def test_surroundings_that_differ_in_one_byte_of_the_hash_do_not_settle(monkeypatch, byte):
    parse, other = suffix_dedup.Parse, np.uint64(1 << 8 * byte)

    def near(gid):
        def of(*args):
            p = parse(*args)
            p.gram[:] = np.uint64(7)
            p.context[:] = np.uint64(5) ^ (other if gid else np.uint64(0))
            return p

        return of

    rows = []
    for gid in (0, 1):
        monkeypatch.setattr(suffix_dedup, "Parse", near(gid))
        text = f"{gid} " + "".join(chr(97 + (i * i + gid) % 26) for i in range(80))
        rows.append(suffix_dedup._phrases(50, 20, 1)(pa.table({"doc_id": [gid], "text": [text], "gid": pa.array([gid], pa.int64())})))
    told = suffix_dedup._dictionary(pa.concat_tables(rows))
    assert all(len(textkit.unpack(x)[0]) == 0 for x in told["blob"].to_pylist())
