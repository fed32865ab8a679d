"""Asset-class templates as data: field rules, silver types, keys and topics (UDX1, UDX3)."""

from loantide.templates.classes import TEMPLATES, Template
from loantide.templates.rules import Rule, amortisation_rules, parse_rules

__all__ = ["TEMPLATES", "Template", "Rule", "amortisation_rules", "parse_rules"]
