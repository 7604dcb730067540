"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemill.llm import (
    html_text,
    language,
    line_index,
    line_rules,
    mixing,
    near_join,
    orchard,
    pii,
    quality_net,
    spelling,
    suffix_blocks,
    templates,
    toxicity,
)
from tidemill.plans.registry import Query
from tidemill.session import apply_settings


def _run(fn):
    def run(spark, sf_dir):
        return fn(apply_settings(spark), sf_dir)

    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    "op1_mix_sources": Query(_run(mixing.op1), mixing.SQL),
    "op2_pii": Query(_run(pii.op2), None),
    "op3_line_rules": Query(_run(line_rules.op3), line_rules.SQL),
    "op4_toxicity": Query(_run(toxicity.op4), None),
    "op5_quality": Query(_run(quality_net.op5), None),
    "op6_suffix_blocks": Query(_run(suffix_blocks.op6), None),
    "op7_language": Query(_run(language.op7), None),
    "op8_near_join": Query(_run(near_join.op8), near_join.SQL),
    "op9_main_text": Query(_run(html_text.op9), None),
    "op10_templates": Query(_run(templates.op10), None),
    "op11_orchard": Query(_run(orchard.op11), orchard.SQL),
    "op12_spelling": Query(_run(spelling.op12), spelling.SQL),
    "op13_line_index": Query(_run(line_index.op13), line_index.SQL),
}
