"""The engine's data: rule packs, credential formats, media types, vocabularies. Small, versioned, and readable as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

VERSION = "2026.08"

#: Exact names of tracking parameters, in alphabetical order.
_EXACT = """
Echobox __hsfp __hssc __hstc __s __twitter_impression _ga _gl _hsenc _openstat action_object_map action_ref_map action_type_map ceneo_spo
cmpid dclid fb_action_ids fb_action_types fb_ref fb_source fbclid gclid gs_l hmb_campaign hmb_medium hmb_source hsCtaTracking
itm_campaign itm_medium itm_source mc_cid mc_eid mc_tc mkt_tok ml_subscriber ml_subscriber_hash msclkid mtm oly_anon_id oly_enc_id
os_ehash rb_clickid ref ref_ referrer s_cid spm srsltid tracking_source twclid utm vero_conv vero_id wickedid wt_mc wt_zmc wtmc wtrid
wtzmc yclid
""".split()
_PREFIXES = {"utm_": "tracking.utm-family", "mtm_": "tracking.mtm-family", "ga_": "tracking.ga", "otm_": "tracking.otm", "vn_": "tracking.vn"}
#: Rules whose id isn't their name without leading underscores.
_NAMED = {"_ga": "tracking.ga-cookie", "hsCtaTracking": "tracking.hs-cta", "__s": "tracking.drip", "ref": "referral.ref", "ref_": "referral.ref-underscore", "referrer": "referral.referrer"}


@dataclass(frozen=True)
class Rule:
    """One cleansing rule: which parameter names it claims."""

    id: str
    kind: str
    match: str  # exact or prefix
    value: str
    evidence: str = "a published list of tracking parameters"
    since: str = "2026-08-01"

    def __post_init__(self):
        if not (self.id and self.kind and self.value and self.evidence and self.match in ("exact", "prefix")):
            raise ValueError(f"incomplete rule {self.id!r}")

    @property
    def precedence(self) -> tuple[int, int, str]:
        """Exact first, then the longer prefix, then the id."""
        return (self.match != "exact", -len(self.value), self.id)


@dataclass(frozen=True)
class Ruleset:
    """A pack of rules."""

    id: str
    version: str
    rules: tuple[Rule, ...] = ()
    _exact: dict = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        if len({r.id for r in self.rules}) < len(self.rules):
            raise ValueError(f"ruleset {self.id!r} has one rule id twice")
        for r in sorted(self.rules, key=lambda r: r.precedence, reverse=True):
            if r.match == "exact":
                self._exact[r.value] = r

    def matching(self, name: str) -> Rule | None:
        """The rule that claims a parameter name."""
        if name in self._exact:
            return self._exact[name]
        return min((r for r in self.rules if r.match == "prefix" and name.startswith(r.value)), key=lambda r: r.precedence, default=None)

    def kinds(self) -> list[str]:
        return sorted({r.kind for r in self.rules})


def _rule(name: str) -> Rule:
    kind = "referral_marketing" if name.startswith("ref") else "tracking_parameter"
    return Rule(_NAMED.get(name, "tracking." + name.lstrip("_").lower().replace("_", "-")), kind, "exact", name)


CORE = Ruleset("core", VERSION, (*map(_rule, _EXACT), *(Rule(i, "tracking_parameter", "prefix", p) for p, i in _PREFIXES.items())))
NONE = Ruleset("none", VERSION)
PACKS = {"core": CORE, "none": NONE}


@dataclass(frozen=True)
class Signature:
    """A credential format: a prefix and at least ``minimum`` characters of an alphabet (the inside of a character class) after it."""

    id: str
    label: str
    prefix: str
    alphabet: str
    minimum: int

    def __post_init__(self):
        if not (self.id and self.prefix and self.alphabet and self.minimum >= 0):
            raise ValueError(f"incomplete signature {self.id!r}")


_B62, _B64 = "0-9A-Za-z", "0-9A-Za-z_\\-"
#: Format; prefix; alphabet; least length of the body; label.
_FORMATS = f"""
aws.access-key; AKIA; A-Z0-9; 16; an access key id of a cloud account
aws.session-key; ASIA; A-Z0-9; 16; a session key id of a cloud account
anthropic.api-key; sk-ant-; {_B64}; 80; a model vendor's API key
github.oauth; gho_; {_B62}; 36; a code host's OAuth token
github.pat-classic; ghp_; {_B62}; 36; a code host's personal token
github.pat-fine-grained; github_pat_; {_B62}_; 70; a code host's fine-grained token
github.refresh; ghr_; {_B62}; 36; a code host's refresh token
github.server-to-server; ghs_; {_B62}; 36; a code host's server token
github.user-to-server; ghu_; {_B62}; 36; a code host's user token
google.api-key; AIza; {_B64}; 35; a search company's API key
key.pem-private; -----BEGIN ; A-Z \\-; 0; a private key block
npm.token; npm_; {_B62}; 36; a package registry's token
openai.project-key; sk-proj-; {_B64}; 40; a project API key
pypi.token; pypi-AgEIcHlwaS5vcmc; {_B64}; 40; a package index's token
sendgrid.key; SG.; {_B64}.; 60; a mail service's API key
slack.app-token; xapp-; {_B62}\\-; 20; a chat app token
slack.bot-token; xoxb-; {_B62}\\-; 20; a chat bot token
slack.user-token; xoxp-; {_B62}\\-; 20; a chat user token
slack.webhook; https://hooks.slack.com/services/; {_B62}/; 20; a chat webhook
stripe.live-restricted; rk_live_; {_B62}; 24; a payment service's restricted key
stripe.live-secret; sk_live_; {_B62}; 24; a payment service's secret key
"""


def _signatures() -> tuple[Signature, ...]:
    out = []
    for line in _FORMATS.strip().splitlines():
        i, prefix, alphabet, least, label = line.split("; ")
        out.append(Signature(i, label, "-----BEGIN " if prefix.startswith("-----") else prefix, alphabet, int(least)))
    return tuple(out)


SIGNATURES = _signatures()

#: Suffix -> media type, for folders and for exported archives.
MEDIA_TYPES = {**dict.fromkeys((".md", ".markdown", ".mdown", ".mkd"), "text/markdown"), **dict.fromkeys((".txt", ".text"), "text/plain"), **dict.fromkeys((".html", ".htm"), "text/html"), ".xhtml": "application/xhtml+xml", ".pdf": "application/pdf"}
ARCHIVE_TYPES = {".md": "text/markdown", ".html": "text/html", ".csv": "text/csv"}
MACHINERY = frozenset(".git .hg .mypy_cache .obsidian .pytest_cache .ruff_cache .svn .trash .venv __pycache__ node_modules venv".split())
MOST_BYTES = 8 << 20

SKIP_REASONS = tuple("bad_fetch_record composite_font credential directory_symlink duplicate extractor_missing machinery no_converter no_main_content no_page_id no_pages no_text_layer not_a_pdf outside_the_root stream_too_large too_deep too_large undecodable unknown_format unparseable_html unreadable unreadable_archive".split())

#: Elements whose text isn't the document's, elements that end with a break, and what a heading starts with.
BOILERPLATE = frozenset("aside footer form head header nav noscript script style template".split())
BLOCKS = frozenset("article blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tr ul".split())
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}

KINDS = ("verbatim", "transformed", "synthetic", "removal")
SOURCE_UNITS = ("characters", "opaque")
LIMITS = (
    "Traceable says that an offset leads to a place in the source, not that the text was read in the right order.",
    "How precise the place is depends on the converter: a page map answers with pages, a character map with characters.",
    "A byte offset follows from a character offset, the encoding, the byte-order mark and the file, and only for characters.",
    "The screener knows formats that their issuers made recognisable; its recall on labelled data is not measured.",
    "Removals are recorded by hash; to confirm one takes the source.",
    "Rules remove what they name; nothing is said about what is left.",
)


def rules(spark: SparkSession, pack: Ruleset = CORE) -> DataFrame:
    """id, kind, match, value, evidence, since: one row a rule."""
    rows = [(r.id, r.kind, r.match, r.value, r.evidence, r.since) for r in pack.rules]
    return spark.createDataFrame(rows, "id string, kind string, match string, value string, evidence string, since string")


def signatures(spark: SparkSession) -> DataFrame:
    """id, label, prefix, alphabet, minimum: one row a format."""
    return spark.createDataFrame([(s.id, s.label, s.prefix, s.alphabet, s.minimum) for s in SIGNATURES], "id string, label string, prefix string, alphabet string, minimum int")
