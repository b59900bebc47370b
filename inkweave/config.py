"""Default values of the operators' parameters."""

from __future__ import annotations

from dataclasses import dataclass

#: English words that carry no content.
STOPWORDS = (
    "a about above after again against all also am an and any are aren as at be because been before being below between both but by can cannot could did do does doing don done down "
    "during each else few for from further had has have having he her here hers herself him himself his how however i if in into is isn it its itself just let may me might more most must "
    "my myself no nor not now of off on once only onto or other ought our ours ourselves out over own same shall she should since so some such than that the their theirs them themselves "
    "then there these they this those through to too under until up upon us very via was we were what when where whether which while who whom why will with within without would you your "
    "yours yourself yourselves"
).split()
#: Words that a search ignores.
SEARCH_STOPWORDS = "a an and are as at be by did do does for from how in is it of on or that the their this to was were what when where which who why with your".split()


@dataclass(frozen=True)
class Defaults:
    sim_threshold: float = 0.62
    sim_top_k: int = 5
    duplicate_threshold: float = 0.93
    max_duplicates: int = 512
    keywords_per_doc: int = 15
    min_shared: int = 2
    keyword_edges_per_doc: int = 5
    entity_edges_per_doc: int = 4
    pairing_df: int = 150
    topic_min_docs: int = 2
    topic_max_fraction: float = 0.33
    chunk_words: int = 148
    chunk_overlap: int = 22
    max_embed_bytes: int = 204_800
    min_mention_len: int = 5
    search_min_score: float = 0.35
    search_limit: int = 12
    stale_days: int = 180
    bridge_top: int = 8
    bridge_min: float = 0.05
    bridge_pivots: int = 512
    max_nodes: int = 4096


D = Defaults()
