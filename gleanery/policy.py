"""Job arguments: domain lists, retry schedule, call spacing and size limits."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default media hosts.
MEDIA_DOMAINS = (
    "youtube.com",
    "youtu.be",
    "vimeo.com",
    "tiktok.com",
    "twitter.com",
    "x.com",
    "instagram.com",
    "facebook.com",
    "fb.watch",
    "linkedin.com",
    "drive.google.com",
)

# Query keys that never change what a page is.
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "si",
    "feature",
    "igshid",
    "igsh",
    "ref",
    "ref_src",
    "s",
    "fbclid",
    "mibextid",
    "gclid",
    "mc_cid",
    "mc_eid",
    "is",
)

# Hosts with their own capture route; anything else is generic HTML.
CODE_DOMAINS = ("github.com",)
BLOCK_PAGE_DOMAINS = ("notion.so", "notion.site", "notion.com")
FILE_DOMAINS = ("drive.google.com",)
GALLERY_DOMAINS = ("instagram.com",)
PROBED_HOST = "drive.google.com"

# Life cycle of an item.
STATUSES = (
    "pending",
    "downloading",
    "transcribing",
    "enriching",
    "writing_note",
    "done",
    "failed",
    "failed_permanent",
    "blocked",
)
TERMINAL_STATUSES = ("done", "blocked", "failed_permanent")
FAILED_STATUSES = ("failed", "failed_permanent")
REFUSED_STATUSES = ("blocked", "failed_permanent")

# Minimum seconds between two call starts, per model provider.
CALL_INTERVALS = {"anthropic": 1.0, "ollama": 0.0, "groq": 2.0, "gemini": 2.0, "cerebras": 2.0}


@dataclass(frozen=True)
class Policy:
    """Everything a run may be told; all of it bounded by what a person writes down."""

    allowed_domains: tuple[str, ...] = MEDIA_DOMAINS
    blocked_domains: tuple[str, ...] = ()
    text_blocked_domains: tuple[str, ...] = ()
    # The usual waits and the number of attempts.
    backoff_minutes: tuple[int, ...] = (1, 5, 30, 120, 480)
    max_attempts: int = 5
    call_intervals: dict[str, float] = field(default_factory=lambda: dict(CALL_INTERVALS))
    render_fallback: bool = True
    skills_enabled: bool = True
    attention_days: int = 30
    artifact_days: int = 30
    state_size_warning: int = 500
