"""The pipeline's encoding stage does all of operator 4: best way, N best, decode check."""
from __future__ import annotations

import corpus_pipeline
from rebuff.llm import pieces
from rebuff.llm.queries import PIECE_MODEL, QUERIES
from tests.llm.test_operators import SF, TRICKY, frame


def test_stage_gives_what_operator_4_gives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: (r.n_pieces, r.score, r.n_best_scores, r.round_trip) for r in QUERIES["op4_sentencepiece"](spark, SF).collect()}
    got = {r.doc_id: (r.n_pieces, r.score, [x.score for x in r.n_best] if r.n_best is not None else None, r.round_trip)
           for r in corpus_pipeline.sentencepiece_encoding(spark, docs, SF).collect()}
    assert got == want and max(len(x[2]) for x in got.values() if x[2]) == pieces.N_BEST


def test_every_way_spells_the_text(spark):
    model = pieces.load(PIECE_MODEL)
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(99, None)]
    for r in corpus_pipeline.sentencepiece_encoding(spark, frame(spark, rows), SF).collect():
        text = dict(rows)[r.doc_id]
        assert r.round_trip
        if text is None:
            assert r.ids is None and r.n_best is None
            continue
        parts = [list(pieces.viterbi(model, c)[0]) for c in (pieces.chunks(text) if text else [])]
        ways = [[list({x.chunk: x.ids for x in w.swaps}.get(k, p)) for k, p in enumerate(parts)] for w in r.n_best]
        assert [i for p in ways[0] for i in p] == list(r.ids) and len({str(w) for w in ways}) == len(ways)
        for w in ways:
            raw = b"".join(bytes((p,)) if isinstance(p := model.pieces[i], int) else p.replace(pieces.SPACE, " ").encode() for x in w for i in x)
            assert raw == (b" " + text.encode() if text else b"")
