"""The dictionary learns from all parts of long documents."""

import numpy as np

from callscope.llm import bpe, tokenfile


def test_samples_come_from_the_whole_document(documents):
    texts = [" ".join(f"w{k * i % 9973}" for i in range(30_000)) for k in range(1, 7)]
    path = bpe.default_tokenizer()
    coder = bpe.tokenizer(path)
    whole = [np.frombuffer(coder.encode(t), "<u4").astype(f"<u{tokenfile._width(coder)}").tobytes() for t in [*texts, "short"]]
    found = tokenfile._samples(documents([(i, t) for i, t in enumerate([*texts, "short"])]).select("doc_id", "text"), path)
    assert len(found) == 7 and all(any(s in w for w in whole) for s in found) and max(map(len, found)) == tokenfile.SAMPLE_BYTES
    places = [w.find(s) / len(w) for s in found for w in whole if s in w]
    assert whole[-1] in found and max(places) > 0.3 and not any(w.startswith(s) for s in found for w in whole[:-1])
