"""Which detectors there are, what they cover, and what a caller should be warned of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from maskwright.operators import detectors, names
from maskwright.plans.options import TYPES, AnalyzeOptions

MATURITY = {"stub": 0, "experimental": 1, "reference": 2}


@dataclass(frozen=True)
class Detector:
    """A named column builder for some types."""

    name: str
    types: tuple[str, ...]
    maturity: str
    build: Callable[[Column, AnalyzeOptions], Column]
    #: Whether its spans are held against the text. Those of the detectors here are cut out of the text itself.
    checked: bool = True


class Registry:
    """Detectors in the order in which they run."""

    def __init__(self, *those: Detector) -> None:
        self.detectors: dict[str, Detector] = {}
        for d in those:
            self.register(d)

    def register(self, detector: Detector) -> None:
        if detector.name in self.detectors:
            raise ValueError(f"There is a detector named {detector.name} already.")
        if not detector.types:
            raise ValueError(f"The detector {detector.name} covers no type.")
        self.detectors[detector.name] = detector

    def replace(self, detector: Detector) -> None:
        """In the place of the one of that name, or at the end."""
        self.detectors[detector.name] = detector

    def select(self, types: tuple[str, ...]) -> list[Detector]:
        """Those that cover any of the types."""
        return [d for d in self.detectors.values() if set(d.types) & set(types)]

    def coverage(self) -> list[tuple[str, str, list[str]]]:
        """Type, best maturity and detectors by name, for each type that is covered."""
        out = []
        for t in TYPES:
            own = [d for d in self.detectors.values() if t in d.types]
            if own:
                out.append((t, max((d.maturity for d in own), key=MATURITY.__getitem__), sorted(d.name for d in own)))
        return out

    def warnings(self, types: tuple[str, ...]) -> list[str]:
        """A sentence for each type without a real detector, and one if any detector is experimental."""
        best = {t: m for t, m, _ in self.coverage()}
        out = [f"{TYPES[t]}: no detector is implemented yet, so nothing in this category was found or replaced." for t in types if best.get(t, "stub") == "stub"]
        if any(best.get(t) == "experimental" for t in types):
            out.append("Some categories can miss matches — please review the list carefully.")
        return list(dict.fromkeys(out))


def default_registry(options: AnalyzeOptions | None = None) -> Registry:
    """All detectors in their order; that of user patterns only where there are any."""
    options = options or AnalyzeOptions()
    given = options.given_names if options.given_names is not None else tuple(names.GIVEN_NAMES)
    registry = Registry(
        Detector("email", ("EMAIL",), "reference", lambda t, o: detectors.email(t), checked=False),
        Detector("phone", ("PHONE",), "reference", lambda t, o: detectors.phone(t, o.default_region), checked=False),
        Detector("credit-card", ("CREDIT_CARD",), "reference", lambda t, o: detectors.credit_card(t), checked=False),
        Detector("sin-ca", ("SSN",), "reference", lambda t, o: detectors.social_number(t), checked=False),
        Detector("ip-address", ("IP_ADDRESS",), "reference", lambda t, o: detectors.ip_address(t), checked=False),
        Detector("url", ("URL",), "reference", lambda t, o: detectors.url(t), checked=False),
    )
    if given:
        registry.register(Detector("nlp-entity", ("PERSON", "ORGANIZATION"), "experimental", lambda t, o: names.lexicon_names(t, given), checked=False))
    for d in (
        Detector("person-sequence", ("PERSON",), "experimental", lambda t, o: names.person_sequences(t), checked=False),
        Detector("address", ("ADDRESS",), "experimental", lambda t, o: detectors.address(t), checked=False),
        Detector("bank-account", ("BANK_ACCOUNT",), "reference", lambda t, o: detectors.bank_account(t), checked=False),
        Detector("government-id", ("GOVERNMENT_ID",), "stub", lambda t, o: detectors.never(t), checked=False),
        Detector("date-of-birth", ("DATE_OF_BIRTH",), "stub", lambda t, o: detectors.never(t), checked=False),
    ):
        registry.register(d)
    if options.custom_patterns:
        registry.register(Detector("custom-regex", ("CUSTOM",), "reference", lambda t, o: detectors.custom(t, o.custom_patterns), checked=False))
    return registry


def capabilities(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """type, label, maturity, detectors of every type; a type nobody covers is a stub."""
    covered = {t: (m, d) for t, m, d in (registry or default_registry()).coverage()}
    rows = [(t, label, *covered.get(t, ("stub", []))) for t, label in TYPES.items()]
    return spark.createDataFrame(rows, "type string, label string, maturity string, detectors array<string>")
