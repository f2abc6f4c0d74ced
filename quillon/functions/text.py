"""Scalar expressions over tokens, labels and vectors, all inside code generation where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are never content, and the hints of a place.
STOP_WORDS = (
    "the and for but not you all can her was one our out are has his how its may new now old see way "
    "who did get let say she too use from have been will with this that they were some them than when "
    "what your each make like just over such take also into only very more does most about which their "
    "would there could other after being where these those first should because through before par aux che del"
).split()
GEO_HINTS = (
    "city country state region continent capital province territory island ocean sea river "
    "mountain lake north south east west europe asia africa america"
).split()


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of doubles, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str, least: float = 1e-12) -> Column:
    """Cosine; 0 where a norm is below ``least``."""
    both = (norm(a) >= least) & (norm(b) >= least)
    return F.when(both, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def cosine_unless_zero(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 only where a norm is exactly 0."""
    both = (norm(a) != 0) & (norm(b) != 0)
    return F.when(both, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def l2_normalize(v: Column | str, least: float = 1e-12) -> Column:
    """The vector over its norm; zeros where the norm is below ``least``."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size >= least, x / size).otherwise(0.0))


def is_readable(token: Column | str) -> Column:
    """1 to 30 bytes when trimmed, at least half of the characters plain."""
    t = F.trim(F.col(token) if isinstance(token, str) else token)
    plain = F.length(F.regexp_replace(t, r"[^A-Za-z0-9 \-'.,]", ""))
    return (F.length(t) > 0) & (F.octet_length(t) <= 30) & (2 * plain >= F.length(t))


def is_content(token: Column | str) -> Column:
    """Readable, 3 to 25 characters, two thirds of them letters, no camel case, no stop word."""
    t = F.trim(F.col(token) if isinstance(token, str) else token)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (
        is_readable(t)
        & F.length(t).between(3, 25)
        & (letters >= F.floor(F.length(t) * 2 / 3))
        & (letters > 0)
        & ~t.rlike("[a-z][A-Z]")
        & ~F.lower(t).isin(STOP_WORDS)
    )


def is_capitalised(token: Column | str) -> Column:
    first = F.substring(token, 1, 1)
    return (F.lower(first) != first) & (F.upper(first) == first)


def classify_relation(layer: Column, layers: Column, target: Column, score: Column, secondaries: Column) -> Column:
    """The relation of a hit by the third of the model that its layer is in, its label and its score."""
    third = F.floor(layers / 3)
    place = F.exists(secondaries, lambda s: F.lower(s).rlike("|".join(GEO_HINTS)))
    capital = is_capitalised(target)
    return (
        F.when((layers == 0) | (layer < third), "related_to")
        .when(layer >= layers - third, "similar_to")
        .when(capital & (score > 30), "part_of")
        .when(capital & place, "located_in")
        .when(capital, "instance_of")
        .when(score > 20, "has_property")
        .otherwise("related_to")
    )


def score_to_distance(score: Column) -> Column:
    return F.when(score <= 0, F.lit(1.7976931348623157e308)).otherwise(1 / (1 + score))


def url_encoded(text: Column | str) -> Column:
    """Percent encoding of every byte that is not unreserved; a space is ``%20``."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_valid_entity(text: Column | str) -> Column:
    """Begins with a capital or digit, not with an article, and has at most four words."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    lower = F.lower(t)
    words = F.size(F.split(t, r"\s+"))
    begins = t.rlike("^[0-9]") | is_capitalised(t)
    return (F.length(t) > 0) & begins & ~lower.startswith("the ") & ~lower.startswith("a ") & (words <= 4)


def filled(template: Column | str, subject: Column | str, obj: Column | str | None = None) -> Column:
    """A prompt template with ``{subject}`` and ``{object}`` filled in."""
    out = F.replace(template, F.lit("{subject}"), F.col(subject) if isinstance(subject, str) else subject)
    return out if obj is None else F.replace(out, F.lit("{object}"), F.col(obj) if isinstance(obj, str) else obj)


# The forms in which families of chat models take a prompt, and the parts of a model's name or the family names that tell them.
CHAT_FORMS = {
    "gemma": "<start_of_turn>user\n{}\n<end_of_turn>\n<start_of_turn>model\n", "mistral": "[INST] {} [/INST]",
    "llama": "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "chatml": "<|im_start|>user\n{}<|im_end|>\n<|im_start|>assistant\n", "plain": "{}",
}
CHAT_NAMES = (("gemma", ["gemma"]), ("mistral", ["mixtral", "mistral"]), ("llama", ["llama"]), ("chatml", ["qwen", "deepseek", "chatml"]))
CHAT_FAMILIES = {"gemma": ["gemma2", "gemma3", "gemma4"], "mistral": ["mistral", "mixtral"], "llama": ["llama"], "chatml": ["qwen", "qwen2", "qwen3", "deepseek", "gpt_oss"]}


def chat_form(name: Column | str) -> Column:
    """The chat form that a model's name tells, the first that fits; plain otherwise."""
    out = F.lit("plain")
    for form, parts in reversed(CHAT_NAMES):
        out = F.when(F.lower(name).rlike("|".join(parts)), form).otherwise(out)
    return out


def family_form(family: Column | str) -> Column:
    """The chat form of a family of models; plain for one that is not known."""
    out, family = F.lit("plain"), F.col(family) if isinstance(family, str) else family
    for form, names in CHAT_FAMILIES.items():
        out = F.when(family.isin(names), form).otherwise(out)
    return out


def wrapped(prompt: Column | str, form: Column) -> Column:
    """A prompt in a chat form."""
    text = F.col(prompt) if isinstance(prompt, str) else prompt
    out = text
    for name, shape in CHAT_FORMS.items():
        before, after = shape.split("{}")
        out = F.when(form == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def model_slug(name: Column | str) -> Column:
    return F.replace(name, F.lit("/"), F.lit("--"))


def band(layer: Column, layers: Column) -> Column:
    """Band of a layer where no preset holds: 40 % syntax, 40 % knowledge, the rest output; '' below 8 layers."""
    syntax, knowledge = F.floor(layers * 2 / 5), F.floor(layers * 4 / 5)
    return (
        F.when(layers < 8, "").when((layer < 0) | (layer >= layers), "unknown")
        .when(layer < syntax, "syntax").when(layer < knowledge, "knowledge").otherwise("output")
    )


def sq8(v: Column | str) -> Column:
    """``struct(codes, lo, hi)``: 8-bit codes over the vector's range; a range of 0 has codes 0."""
    lo, hi = F.array_min(v), F.array_max(v)
    codes = F.transform(v, lambda x: F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(255), F.round((x - lo) * 255 / (hi - lo))))).otherwise(0).cast("int"))
    return F.struct(codes.alias("codes"), lo.alias("lo"), hi.alias("hi"))


def sq8_decoded(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["lo"] + c * (q["hi"] - q["lo"]) / 255)


def sq8_distance(v: Column | str, q: Column) -> Column:
    """Euclidean distance of a vector to a decoded one."""
    return F.sqrt(F.aggregate(F.zip_with(v, sq8_decoded(q), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
