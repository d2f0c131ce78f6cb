"""Label map, theme rules and trigger settings as small dimensions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNCLASSIFIED = "Unclassified / Ambient"
SILENCE = "Relative silence"

# The dashboard's macro categories, which theme belongs to which,
# and the labels and themes that never vote.
MACROS = ("Traffic & Transit", "Human & Community", "Environmental & Weather", "Infrastructure & Mechanical", UNCLASSIFIED)
THEME_TO_MACRO = {
    "Vehicles": "Traffic & Transit",
    "Human voice": "Human & Community",
    "Human non-speech": "Human & Community",
    "Music": "Human & Community",
    "Animals": "Human & Community",
    "Nature and weather": "Environmental & Weather",
    "Environments / noise": "Environmental & Weather",
    "Tools and industry": "Infrastructure & Mechanical",
    "Alarms and signals": "Infrastructure & Mechanical",
    "Other": UNCLASSIFIED,
    "Domestic / interior": UNCLASSIFIED,
}
LABEL_OVERRIDES = {"Vehicle / Tire Rolling": "Traffic & Transit"}
BLACKLIST_LABELS = (
    "Heart sounds, heartbeat", "Heart murmur", "Printer", "Typewriter", "Computer keyboard", "Writing", "Door", "Doorbell",
    "Cupboard open or close", "Drawer open or close", "Dishes, pots, and pans", "Cutlery, silverware", "Sink (filling or washing)",
    "Bathtub (filling or washing)", "Toilet flush", "Keys jangling", "Coin (dropping)", "Scissors", "Microwave oven", "Blender",
    "Hair dryer", "Toothbrush", "Electric toothbrush", "Vacuum cleaner",
)
BLACKLIST_THEMES = ("Domestic / interior",)
HISS_LABELS = ("Wind", "White noise", "Mechanical fan")
HISS_TARGET, HISS_ABOVE = "Vehicle / Tire Rolling", 52.0
# Some keywords of the first rules that a label meets; the whole table of keywords is a
# file that ``load_theme_rules`` reads.
THEME_RULES = (
    ("Human voice", ("speech", "conversation", "shout", "whisper")),
    ("Human non-speech", ("laughter", "crying", "breathing", "cough", "footsteps")),
    ("Music", ("music", "guitar", "piano", "drum", "singing")),
    ("Animals", ("animal", "dog", "bark", "cat", "bird")),
    ("Vehicles", ("vehicle", "car", "truck", "train", "engine")),
    ("Alarms and signals", ("alarm", "siren", "bell")),
    ("Tools and industry", ("tool", "drill", "saw", "vacuum")),
    ("Domestic / interior", ("door", "dishes", "toilet")),
    ("Nature and weather", ("wind", "rain", "thunder", "water")),
    ("Environments / noise", ("silence", "noise", "static", "hum")),
)
OTHER = "Other"


@dataclass(frozen=True)
class LabelMap:
    """Everything that turns a classifier's label into a vote and a macro category."""

    min_confidence: float = 0.25
    macros: tuple[str, ...] = MACROS
    theme_to_macro: dict[str, str] = field(default_factory=lambda: dict(THEME_TO_MACRO))
    overrides: dict[str, str] = field(default_factory=lambda: dict(LABEL_OVERRIDES))
    blacklist: tuple[str, ...] = BLACKLIST_LABELS
    blacklist_themes: tuple[str, ...] = BLACKLIST_THEMES
    threshold: float = 45.0
    max_gap: int = 2
    min_chunks: int = 2
    hiss: tuple[str, ...] = HISS_LABELS
    hiss_target: str = HISS_TARGET
    hiss_above: float = HISS_ABOVE


def load_label_map(path: str) -> LabelMap:
    """A label map from a JSON object; absent keys keep their defaults."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise ValueError("a label map must be an object")
    base, seg, hiss = LabelMap(), data.get("segmentation") or {}, data.get("tire_hiss") or {}
    return LabelMap(
        float(data.get("min_confidence", base.min_confidence)), tuple(data.get("macros", base.macros)), data.get("theme_to_macro", base.theme_to_macro), data.get("label_overrides", base.overrides),
        tuple(data.get("blacklist_labels", base.blacklist)), tuple(data.get("blacklist_themes", base.blacklist_themes)),
        float(seg.get("active_dba_threshold", base.threshold)), int(seg.get("max_gap_chunks", base.max_gap)), int(seg.get("min_event_chunks", base.min_chunks)),
        tuple(hiss.get("source_labels", base.hiss)), hiss.get("target_label", base.hiss_target), float(hiss.get("confused_min_event_max_dba", base.hiss_above)),
    )


def load_theme_rules(path: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Ordered rules from a JSON list of [theme, [keyword, ...]]."""
    with open(path, encoding="utf-8") as f:
        return tuple((theme, tuple(words)) for theme, words in json.load(f))


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """index, mid and display_name of a classifier's classes from CSV."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema="index int, mid string, display_name string")
    return rows.withColumn("display_name", F.trim(F.regexp_replace(F.trim("display_name"), '^"+|"+$', "")))


def theme_of(labels: DataFrame, rules=THEME_RULES) -> DataFrame:
    """``labels(display_name)`` with the theme of the first rule, in order, one of whose keywords the name contains."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # One expression as text: hundreds of keywords would be hundreds of calls from Python.
    cases = [f"WHEN {' OR '.join(f'contains(_low, {quoted(w)})' for w in words)} THEN {quoted(name)}" for name, words in rules if words]
    theme = F.expr(f"CASE {' '.join(cases)} ELSE {quoted(OTHER)} END") if cases else F.lit(OTHER)
    return labels.withColumn("_low", F.lower("display_name")).withColumn("theme", F.coalesce(theme, F.lit(OTHER))).drop("_low")


#: Keywords of a rule table that is sent to all workers.
MOST_KEYWORDS = 10_000


def rule_rows(spark: SparkSession, rules=THEME_RULES) -> DataFrame:
    """Rules as a dimension: rule (their order), theme and keyword."""
    rows = [(i, theme, w) for i, (theme, words) in enumerate(rules) for w in words]
    return spark.createDataFrame(rows, "rule int, theme string, keyword string")


def read_theme_rules(spark: SparkSession, path: str) -> DataFrame:
    """The same from a CSV file with these three columns; keywords in any script, lower-cased and trimmed, empty ones left out."""
    rows = spark.read.csv(path, header=True, escape='"', schema="rule int, theme string, keyword string")
    return rows.withColumn("keyword", F.lower(F.trim("keyword"))).filter("keyword <> '' AND rule IS NOT NULL")


def theme_catalog(classes: DataFrame, rules: DataFrame | tuple = THEME_RULES) -> DataFrame:
    """Per class (index, mid, display_name) its theme: the catalog that votes look labels up in.

    All keywords go into one automaton, built once by each worker, that finds
    them in one pass over a name; of the rules that have one the first decides,
    and without any the theme is Other.  A table of more than MOST_KEYWORDS is an error.
    """
    table = rules if isinstance(rules, DataFrame) else rule_rows(classes.sparkSession, rules)
    rows = [tuple(r) for r in table.select("rule", "theme", "keyword").limit(MOST_KEYWORDS + 1).collect()]
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    first: dict[str, int] = {}
    for rule, _, word in rows:
        first[word] = min(rule, first.get(word, rule))
    names = {rule: theme for rule, theme, _ in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for word, rule in first.items():
            words.add_word(word, rule)
        if first:
            words.make_automaton()
        for batch in batches:
            low = [x or "" for x in batch.column("_low").to_pylist()]
            best = [min((rule for _, rule in words.iter(x)), default=None) if first else None for x in low]
            yield pa.RecordBatch.from_arrays([batch.column("display_name"), pa.array([OTHER if r is None else names[r] for r in best], pa.string())], names=["display_name", "theme"])

    low = classes.select("display_name", F.lower("display_name").alias("_low")).distinct()
    themes = low.mapInArrow(run, "display_name string, theme string")
    named = themes.withColumnRenamed("display_name", "_name")
    return classes.drop("theme").join(named, F.col("display_name").eqNullSafe(F.col("_name")), "left").drop("_name")


def with_catalog(chunks: DataFrame, catalog: DataFrame, name: str = "top_label") -> DataFrame:
    """``chunks`` with the theme that a catalog (display_name, theme) has for a label column, null where it has none.

    Class names are some hundreds, so Catalyst broadcasts the catalog by its size.
    """
    themes = catalog.groupBy(F.col("display_name").alias(name)).agg(F.min("theme").alias("theme"))
    return chunks.drop("theme").join(themes, name, "left")


@dataclass(frozen=True)
class TriggerConfig:
    """When a capture is armed and how it ends."""

    trigger: tuple[str, ...] = ("Vehicle", "Speech")
    ambiguous: tuple[str, ...] = ("Wind",)
    loud_dba: float = 55.0
    cooldown_s: float = 5.0
    end_settle: int = 2
    max_event_s: float = 5.0
    decay_db: float = 5.0
    onset_margin_db: float = 3.0
    pad_ms: float = 150.0
    lookback_s: float = 4.0
    warm_rows: int = 1

    def normalised(self) -> TriggerConfig:
        """Labels trimmed, distinct and sorted; what triggers isn't ambiguous."""
        clean = lambda xs: tuple(sorted({x.strip() for x in xs if x.strip()}))
        trigger = clean(self.trigger)
        return replace(self, trigger=trigger, ambiguous=tuple(x for x in clean(self.ambiguous) if x not in trigger))


#: Keys of a stored trigger configuration.
_TRIGGER_KEYS = {
    "cooldown_seconds": "cooldown_s", "dba_threshold": "loud_dba", "lookback_seconds": "lookback_s", "pre_onset_pad_ms": "pad_ms", "end_settle_chunks": "end_settle",
    "max_event_seconds": "max_event_s", "onset_dba_margin_db": "onset_margin_db", "peak_decay_db": "decay_db", "trigger_labels": "trigger", "ambiguous_labels": "ambiguous",
}


def load_trigger_config(path: str) -> TriggerConfig:
    """A trigger configuration from JSON; labels that an old file suppresses trigger nothing."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    off = {str(x).strip().lower() for x in data.get("suppress_labels") or ()}
    found = {}
    for key, name in _TRIGGER_KEYS.items():
        if isinstance(value := data.get(key, () if key.endswith("labels") else None), (list, tuple)):
            found[name] = tuple(str(x) for x in value if str(x).strip().lower() not in off)
        elif value is not None:
            found[name] = int(value) if name == "end_settle" else float(value)
    return TriggerConfig(**found).normalised()


def save_trigger_config(config: TriggerConfig, path: str) -> None:
    config = config.normalised()
    with open(path, "w", encoding="utf-8") as f:
        json.dump({key: getattr(config, name) for key, name in _TRIGGER_KEYS.items()}, f, indent=2)


@dataclass(frozen=True)
class WindowConfig:
    """Fixed windows of the detector, and what makes a span of its frames."""

    pre_roll_s: float = 5.0
    post_roll_s: float = 5.0
    frame_threshold: float = 0.5
    min_span_s: float = 0.02
    frames_per_second: float = 50.0

    def normalised(self) -> WindowConfig:
        """Values held to their bounds."""
        return WindowConfig(max(0.1, self.pre_roll_s), max(0.1, self.post_roll_s), min(1.0, max(0.0, self.frame_threshold)), max(0.0, self.min_span_s), max(1.0, self.frames_per_second))


def load_window_config(path: str) -> WindowConfig:
    """A window configuration from JSON; absent keys, or an absent file, have the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except FileNotFoundError:
        data = {}
    return WindowConfig(**{k: float(data[k]) for k in vars(WindowConfig()) if k in data}).normalised()


def save_window_config(config: WindowConfig, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(vars(config.normalised()), f, indent=2)


def check_prompts(pairs: list[tuple[str, str]], most: int | None = None) -> list[tuple[str, str]]:
    """Prompt pairs with unique, non-empty labels and prompts, at most ``most`` of them."""
    out = [(label.strip(), prompt.strip()) for label, prompt in pairs]
    if not all(a and b for a, b in out) or len({a for a, _ in out}) < len(out) or (most is not None and len(out) > most):
        raise ValueError("labels must be unique, prompts not empty, and not too many")
    return out


def load_prompts(path: str, most: int | None = None) -> list[tuple[str, str]]:
    """Prompt pairs from a JSON object with ``prompts`` or a JSON list."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    raw = data if isinstance(data, list) else data.get("prompts", [])
    return check_prompts([(str(x.get("label", "")), str(x.get("prompt", ""))) for x in raw], most)


def save_prompts(pairs: list[tuple[str, str]], path: str, most: int | None = None, prefix: str = "") -> None:
    pairs = check_prompts(pairs, most)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"prompt_prefix": prefix, "prompts": [{"label": a, "prompt": b} for a, b in pairs]}, f, indent=2)


def prompts_hash(pairs: list[tuple[str, str]]) -> str:
    """First 16 hex digits of the SHA-256 of the pairs as compact JSON in their order."""
    import hashlib

    text = json.dumps([{"label": a, "prompt": b} for a, b in pairs], ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]
