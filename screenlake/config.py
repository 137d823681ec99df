"""Settings of screening and of refreshes."""

from __future__ import annotations

from dataclasses import dataclass, field

SOURCES = ("ofac_sdn", "ofac_consolidated", "eu", "uk", "un")
ENTITY_TYPES = ("person", "organization", "vessel", "aircraft", "unknown")
LABELS = {"ofac_sdn": "OFAC SDN list", "ofac_consolidated": "OFAC consolidated list", "eu": "EU consolidated list", "uk": "UK sanctions list", "un": "UN Security Council list"}
REGISTRY_LABEL = "Legal entity identifiers"
LICENCES = {"ofac_sdn": "Public domain, work of the US government", "ofac_consolidated": "Public domain, work of the US government", "eu": "Free reuse with a mention of the source", "uk": "Open Government Licence v3.0, with attribution", "un": "Free reuse", "lei": "CC0 1.0"}
CAVEAT = "Candidates for review, not a determination: compare identifiers with the published entry before acting."


@dataclass(frozen=True)
class Settings:
    min_score: float = 0.85
    max_fuzzy: int = 50
    strict_cap: int | None = 5000
    lei_cap: int | None = 2000
    refresh_cron: str = "0 4 * * *"
    warehouse: str = "spark-warehouse"
    urls: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check(0 <= self.min_score <= 1, "min_score is between 0 and 1")
        check(self.max_fuzzy >= 1, "max_fuzzy is at least 1")

    @property
    def pool_limit(self) -> int:
        """Candidates of one blocking key."""
        return max(4 * self.max_fuzzy, 200)


def sources_table(urls: dict[str, str]) -> list[dict[str, str | None]]:
    """(source, label, url, licence) of the five lists and the entity registry. ``urls``: where each is fetched from."""
    return [{"source": s, "label": label, "url": urls.get(s), "licence": LICENCES[s]} for s, label in [*LABELS.items(), ("lei", REGISTRY_LABEL)]]


class InvalidRequest(ValueError):
    """A parameter is out of its bounds."""


class NotReady(RuntimeError):
    """The corpus has never been completed."""


class NotFound(LookupError):
    """No such designation or entity."""


def check(fine: bool, what: str) -> None:
    if not fine:
        raise InvalidRequest(what)
