"""Rule catalogue, skip lists and configuration, resolved on the driver before planning."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from quillspark.operators.replacements import Replacement

# Numbers, keywords and what each rule does.
CATALOGUE = {
    1: ("line-endings", "LF line ends and a final one"),
    2: ("trailing", "no trailing white space but a two-space break"),
    3: ("blank-lines", "one blank line at most; none before definitions"),
    4: ("header-spacing", "one space after #"),
    5: ("header-newline", "blank line after a heading"),
    6: ("code-before", "blank line before a code block"),
    7: ("code-after", "blank line after a code block"),
    8: ("list-before", "blank line before a list"),
    9: ("list-after", "blank line after a list"),
    10: ("rule-before", "blank line before a horizontal rule"),
    11: ("rule-after", "blank line after a horizontal rule"),
    12: ("list-tabs", "tabs for list indents"),
    13: ("list-marker", "one space after a list marker"),
    14: ("wrap", "lines wrapped at a width"),
    15: ("end-newline", "one blank line at the end"),
    16: ("ial-spacing", "spacing of attribute lists"),
    17: ("code-lang-spacing", "no space before a fence's language"),
    18: ("ref-link-spacing", "spacing of link definitions"),
    19: ("task-checkbox", "lower-case x in task boxes"),
    20: ("blockquote-spacing", "one space after quote markers"),
    21: ("math-spacing", "spacing of math"),
    22: ("table-format", "aligned tables"),
    23: ("emoji-spellcheck", "known emoji names"),
    24: ("typography", "plain quotes, dashes and dots"),
    25: ("bold-italic", "__ for bold, * for italic"),
    26: ("list-markers", "list numbers in order, bullets by level"),
    27: ("list-reset", "ordered lists start at 1"),
    28: ("reference-links", "numbered reference links"),
    29: ("links-at-end", "link definitions at the end"),
    30: ("inline-links", "links in inline form"),
    31: ("liquid-tags", "spacing of template tags"),
    32: ("blockquote-markers", "quote markers without spaces between"),
    33: ("compress-lists", "no blank lines between list items"),
}
KEYWORDS = {word: n for n, (word, _) in CATALOGUE.items()}
GROUPS = {"code-block-newlines": {6, 7}, "display-math-newlines": {21}, "emphasis": {25}}
WIDTH = 60
LOCAL_CONFIG, LOCAL_REPLACEMENTS = ".quillspark.yml", ".quillspark-replacements.yml"


@dataclass(frozen=True)
class Options:
    width: int = WIDTH
    skip: frozenset[int] = frozenset({30})
    em_dash: bool = True
    guillemet: bool = True
    reverse_emphasis: bool = False
    replacements: tuple[Replacement, ...] = ()
    emoji_names: tuple[str, ...] | None = None
    emoji_max_distance: int = 4
    #: Link definitions that nothing uses stay, after the others.
    keep_unreferenced: bool = False
    #: Sinks rewrite the files that documents came from.
    overwrite: bool = False

    def on(self, rule: int) -> bool:
        return rule not in self.skip

    @property
    def link_style(self) -> str | None:
        """inline, end, beginning or None.  Definitions at the end imply references."""
        if self.on(30):
            return "inline"
        if self.on(29):
            return "end"
        return "beginning" if self.on(28) else None


@dataclass
class Skips:
    rules: set[int] = field(default_factory=set)
    em_dash: bool = False
    guillemet: bool = False


def parse_skips(text: str | list) -> Skips:
    """Numbers, keywords and groups, comma-separated or listed; unknown ones are errors."""
    out = Skips()
    for word in (w.strip() for w in text.split(",")) if isinstance(text, str) else map(str, text):
        if word in GROUPS:
            out.rules |= GROUPS[word]
        elif word in ("em-dash", "guillemet"):
            setattr(out, word.replace("-", "_"), True)
        elif word.isdigit():
            if int(word) not in CATALOGUE:
                raise ValueError(f"no rule {word}")
            out.rules.add(int(word))
        elif word in KEYWORDS:
            out.rules.add(KEYWORDS[word])
        else:
            raise ValueError(f"no rule named {word}")
    return out


def resolve(config: dict | None = None, skip: str | None = None, width: int | None = None, reverse_emphasis: bool = False, replacements: list[Replacement] | None = None, overwrite: bool = False) -> Options:
    """Options of a run: the command's width and skips over the configuration's; files are
    overwritten if either says so.

    ``rules: {skip: all, include: [...]}``, ``{skip: [...]}`` and ``{include: [...]}`` are
    understood.  Inline links are off unless ``include`` names them.
    """
    config = config or {}
    rules = config.get("rules") or {}
    off, flags = {30}, Skips()
    if rules.get("skip") == "all":
        off = set(CATALOGUE)
    elif rules.get("skip"):
        flags = parse_skips(rules["skip"])
        off |= flags.rules
    if rules.get("include"):
        off -= parse_skips(rules["include"]).rules
    if skip:
        more = parse_skips(skip)
        off |= more.rules
        flags = Skips(set(), flags.em_dash or more.em_dash, flags.guillemet or more.guillemet)
    return Options(width or config.get("width") or WIDTH, frozenset(off), not flags.em_dash, not flags.guillemet, reverse_emphasis, tuple(replacements or ()), keep_unreferenced=bool(config.get("keep_unreferenced")), overwrite=overwrite or bool(config.get("overwrite")))


def config_folder() -> Path:
    """Where a user's configuration lives: below ``$XDG_CONFIG_HOME``, else ``~/.config``."""
    base = os.environ.get("XDG_CONFIG_HOME")
    return (Path(base) if base else Path.home() / ".config") / "quillspark"


def read_config(folders: list[str] | None = None) -> dict:
    """The first readable YAML configuration: the working folder's, then the user's.

    A file that YAML rejects is passed over.  Other folders may be given instead; each is
    searched for any of the three names."""
    import yaml

    if folders is None:
        paths = [Path(LOCAL_CONFIG), config_folder() / "config.yml", config_folder() / "config.yaml"]
    else:
        paths = [Path(f).expanduser() / name for f in folders for name in (LOCAL_CONFIG, "config.yml", "config.yaml")]
    for path in paths:
        try:
            found = yaml.safe_load(path.read_text()) if path.is_file() else None
        except (yaml.YAMLError, UnicodeDecodeError):
            continue
        if isinstance(found, dict):
            return found
    return {}


def replacements_file(config: dict, given: str | None = None) -> str | None:
    """The file to read: the one given, the configuration's, the working folder's, the user's."""
    if given or config.get("replacements_file"):
        return given or config["replacements_file"]
    found = [p for p in (Path(LOCAL_REPLACEMENTS), config_folder() / "replacements.yml") if p.is_file()]
    return str(found[0]) if found else None


def load_replacements(config: dict, spark=None, given: str | None = None, wanted: bool | None = None) -> list[Replacement]:
    """Replacements of a run.  ``wanted`` (the command) wins over the configuration's
    ``replacements: true|false``; without either they apply if a file is found."""
    wanted = config.get("replacements") if wanted is None else wanted
    path = replacements_file(config, given) if wanted is None or wanted else None
    return read_replacements(path, spark) if path and Path(path).expanduser().is_file() else []


def read_replacements(path: str, spark=None) -> list[Replacement]:
    """A YAML list of replacements; an entry whose pattern Java rejects is left out with a warning."""
    import yaml

    items = yaml.safe_load(Path(path).expanduser().read_text()) or []
    items = items.get("replacements", []) if isinstance(items, dict) else items
    keys = set(Replacement.__dataclass_fields__)
    out = [Replacement(**{k: v for k, v in i.items() if k in keys}) for i in items]
    if spark is None:
        return out
    compile_ = spark._jvm.java.util.regex.Pattern.compile

    def good(r: Replacement) -> bool:
        try:
            compile_(r.java[0])
        except Exception as e:  # whatever the gateway raises for a bad pattern
            warnings.warn(f"replacement {r.name!r} is skipped, its pattern is invalid: {type(e).__name__}", stacklevel=3)
            return False
        return True

    return [r for r in out if good(r)]


def default_config() -> str:
    """A configuration that turns every rule on, as YAML."""
    return "width: 60\noverwrite: false\nrules:\n  skip: all\n  include:\n" + "".join(f"    - {w}\n" for w in KEYWORDS)
