from parasift.options import AnalyzerOptions, SummarizerOptions, style_from_name


def test_defaults():
    o = AnalyzerOptions()
    assert (o.mmr_lambda, o.top_n, o.rerank, o.top_m, o.query_mode, o.max_seq_len) == (0.65, 10, False, 30, "centroid_summary", 512)
    s = SummarizerOptions()
    assert (s.style, s.temperature, s.max_tokens) == ("abstract_with_bullets", 0.2, None)


def test_from_map_ignores_bad_and_unknown():
    o = AnalyzerOptions.from_map({"mmr_lambda": "0.3", "top_n": "x", "rerank": "True", "zzz": "1", "backend": "cpu"})
    assert o.mmr_lambda == 0.3 and o.top_n == 10 and o.rerank is False and o.backend == "cpu"
    s = SummarizerOptions.from_map({"style": "nope", "max_tokens": "256", "timeout_ms": "-1"})
    assert s.style == "abstract_with_bullets" and s.max_tokens == 256 and s.timeout_ms == 30000
    assert style_from_name("tldr") == "tldr"
