"""The codebook: closed sets of labels, from which enums, checks and prompts derive."""

from __future__ import annotations

# Label sets in the order of their numeric codes, conservative labels, relation schema.
LEVELS = {
    "relevance": ["relevant", "not_relevant"],
    "stance": ["trust", "distrust", "ambivalent", "non_evaluative"],
    "dimension": ["competence_reliability", "integrity_motives", "safety_risk", "transparency", "societal_impact", "not_applicable"],
    "target": ["specific_model", "company", "technology_general", "community_users", "not_applicable"],
    "incivility_direction": ["at_user", "at_third_party", "at_ai", "none"],
}
INCIVILITY = ["name_calling", "vulgarity", "aspersion", "lying_accusation", "pejorative_speech", "identity_attack", "threat"]
CONSERVATIVE = {"relevance": "not_relevant", "stance": "non_evaluative", "dimension": "not_applicable", "target": "not_applicable", "incivility_direction": "none"}
TRUTHY = ["x", "1", "y", "yes", "true", "t"]
ENTITY_TYPES = ["model", "company", "capability", "harm", "actor", "policy"]
RELATIONS = ["accuses_of", "outperforms", "trusted_for", "distrusted_for", "threatens", "regulates", "replaces", "fabricates_about", "competes_with", "depends_on"]
VALENCES = ["trusting", "distrusting", "neutral"]


def prompt_block(fields: list[str] | None = None, compact: bool = False) -> str:
    """The codebook as text for a prompt: a heading a field, a line a level (compact: one line a field)."""
    chosen = fields or list(LEVELS)
    if compact:
        return "\n".join(f"{f}: {' | '.join(LEVELS[f])}" for f in chosen)
    return "\n\n".join("\n".join([f"## {f}", *(f"{i}. {v}" for i, v in enumerate(LEVELS[f], 1))]) for f in chosen)
