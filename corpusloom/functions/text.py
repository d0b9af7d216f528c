"""Text functions as Column expressions: normalising, counting, tokens, lexical flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tombstones, bot and moderator names, entities in decoding order, cleaning rules in order,
# function words, terms of the relevance flag, second person, word lists of incivility.
TOMBSTONES = ["[deleted]", "[removed]", "[unavailable]", ""]
BOT_PATTERN = r"(?i)^(automoderator|.*[-_]?bot[0-9]*|b0t|.*_ai_bot)$"
BOT_NAMES = ["[deleted]", "AutoModerator", "RemindMeBot", "sneakpeekbot", "WikiSummarizerBot", "totesmessenger"]
MODERATOR_PATTERN = r"(?i)(modteam|mod[-_ ]?team|moderator)$"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&#x200B;", " ")]
CLEANING = [
    (r"(?s)```.*?```", " "),
    (r"(?m)^\s{4,}\S.*$", " "),
    (r"(?m)^\s*>.*$", " "),
    (r"\[([^\]]{1,200})\]\([^)]*\)", "$1"),
    (r"https?://\S+", " "),
    (r"/?[ru]/[A-Za-z0-9_-]+", " "),
    (r"[*_~`^]+", ""),
    (r"(?m)^#{1,6}\s*", ""),
    (r"\s+", " "),
]
FUNCTION_WORDS = [
    "the", "and", "to", "of", "a", "in", "is", "it", "you", "that", "for", "on", "this", "but", "not", "with", "are", "have", "be", "was", "i", "my",
    "we", "they", "do", "so", "if", "just", "like", "can", "what", "how", "why", "would", "about", "there", "their", "from", "all", "get", "one",
    "out", "up", "more", "will",
]
RELEVANCE_PATTERN = (
    r"\b(a\.?i\.?|artificial intelligence|agi|asi|llm|llms|gpt[0-9.-]*|chat ?gpt|openai|open ai|sam altman|altman|claude|anthropic|gemini|bard|"
    r"deepseek|qwen|llama|mistral|grok|xai|copilot|perplexity|midjourney|dall[- ]?e|stable diffusion|sora|veo|nano ?banana|flux|"
    r"chatbot|chat bot|language model|foundation model|neural net(work)?|machine learning|deep learning|transformer|diffusion model|"
    r"prompt(s|ing|ed)?|token(s|izer)?|fine[- ]?tun(e|ed|ing)|rlhf|hallucinat(e|es|ed|ing|ion|ions)|alignment|safety team|"
    r"training data|context window|inference|agentic|agents?|automat(e|ed|ion)|robot(s|ics)?|algorithm(s|ic)?)\b"
)
SECOND_PERSON = ["you", "your", "yours", "u", "ur"]
VULGARITY = ["fuck", "fucking", "fucked", "shit", "shitty", "bullshit", "ass", "asshole", "damn", "crap", "piss", "bitch", "bastard", "dick", "cunt", "wtf", "stfu", "fck", r"f\*+k", r"sh\*+t"]
NAME_CALLING = [
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "dumbass", "clown", "clowns", "loser", "losers", "pathetic", "braindead", "brain-dead",
    "delusional", "shill", "shills", "sheep", "npc", "incel", "grifter", "grifters", "fanboy", "fanboys", "cultist", "cultists", "troll", "trolls",
]
LYING = ["lying", "liar", "liars", "lie", "lies", "astroturf", "astroturfing", "bot", "bots", "bad faith", "shilling", "paid", "psyop", "gaslighting"]
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "would", "should", "could", "ought", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "will", "just",
]

TOKEN = r"[\p{L}\p{N}_]+"


def decode_entities(c: Column) -> Column:
    """HTML entities, the ampersand first, so that doubly encoded ones decode fully."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), ENTITIES, c)


def normalise(c: Column) -> Column:
    """Entities decoded; code, quotes, links, mentions, emphasis and headers stripped; white space squeezed and trimmed.

    Character classes are Unicode's. A null stays null.
    """
    cleaned = reduce(lambda x, r: F.regexp_replace(x, "(?U)" + r[0], r[1]), CLEANING, decode_entities(c))
    return F.trim(cleaned)


def valid_utf8(c: Column) -> Column:
    """The text with every malformed byte sequence as U+FFFD."""
    return F.make_valid_utf8(c)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")


def link_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("https?://")).cast("long")


def char_count(c: Column, char: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("long")


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def tokens_in(toks: Column, words: list[str]) -> Column:
    """How many tokens are among the words."""
    return F.size(F.filter(toks, lambda x: x.isin(words))).cast("long")


def without(toks: Column, words: list[str]) -> Column:
    return F.filter(toks, lambda x: ~x.isin(words))


def _runs(toks: Column, n: int) -> Column:
    at = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))


def ngrams(toks: Column, longest: int = 2) -> Column:
    """All 1- to n-grams, joined by a blank, shorter ones first."""
    parts = [toks]
    for n in range(2, longest + 1):
        parts.append(_runs(toks, n))
    return F.concat(*parts)


def bigrams(toks: Column) -> Column:
    """All pairs of neighbouring tokens, joined by a blank."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, F.lit(1), n), F.slice(toks, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def run_starts(ordered: Column) -> Column:
    """Where, counted from 0, the runs of equal terms of a sorted array begin."""
    at = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)))


def ratio(a: Column, b: Column) -> Column:
    """a / b with a divisor of one at least."""
    return a / F.greatest(F.lit(1), b)


def latin_ratio(c: Column) -> Column:
    return ratio(F.regexp_count(c, F.lit("[A-Za-z]")), F.length(c))


def caps_ratio(c: Column) -> Column:
    return ratio(F.regexp_count(c, F.lit("[A-Z]")), F.regexp_count(c, F.lit("[A-Za-z]")))


def is_english(c: Column, n_words: Column, toks: Column | None = None, least_words: float = 0.08, least_latin: float = 0.45) -> Column:
    """Function words and Latin letters each make up their share; toks: the tokens, where they are at hand."""
    return (ratio(tokens_in(tokens(c) if toks is None else toks, FUNCTION_WORDS), n_words) >= least_words) & (latin_ratio(c) >= least_latin)


def word_flag(c: Column, words: list[str]) -> Column:
    """Whether one of the words, which may be patterns, occurs between word boundaries, in any case."""
    return c.rlike(r"(?iU)\b(" + "|".join(words) + r")\b")


def token_flag(toks: Column, words: list[str]) -> Column:
    """As word_flag for plain single words, on tokens."""
    return F.arrays_overlap(toks, F.array(*(F.lit(w) for w in words if w.isalpha())))


def relevance_flag(c: Column) -> Column:
    return c.rlike("(?iU)" + RELEVANCE_PATTERN)


def is_bot(author: Column) -> Column:
    return author.rlike(BOT_PATTERN) | author.isin(BOT_NAMES)


def is_moderation(author: Column, distinguished: Column) -> Column:
    return (F.coalesce(distinguished, F.lit("")) == "moderator") | author.rlike(MODERATOR_PATTERN)


def thread_slug(permalink: Column) -> Column:
    return F.replace(F.split_part(permalink, F.lit("/"), F.lit(6)), F.lit("_"), F.lit(" "))


def glob_pattern(term: str) -> str:
    """A dictionary entry as a pattern of its own: `*` ends in any letters, blanks match any white space."""
    import re

    return r"\b" + re.escape(term.rstrip("*")).replace(r"\ ", r"\s+") + (r"\w*" if term.endswith("*") else r"\b")
