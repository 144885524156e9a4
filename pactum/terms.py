"""IRIs, prefixes and the fixed vocabularies of licence descriptions.

Two namespaces depend on whose licence library is loaded (its own terms, and its licences); they are parameters of
`Vocabulary`. The driver-table queries use compact names, so they need neither.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Public namespaces.
PREFIXES = {
    "bpicountry": "http://www.bpiresearch.com/BPMO/2004/03/03/cdl/Countries#",
    "cc": "http://creativecommons.org/ns#",
    "dcmitype": "http://purl.org/dc/dcmitype/",
    "dct": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "odrl": "http://www.w3.org/ns/odrl/2/",
    "osl": "http://opensource.org/licenses/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "scho": "http://schema.org/",
    "spdx": "http://spdx.org/rdf/terms#",
    "spdxlicense": "http://spdx.org/licenses/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
HOUSE, LIBRARY = "lic", "liclib"

#: Predicates that tie a licence to its statements.
STATEMENT_KINDS = {"odrl:permission": "permission", "odrl:prohibition": "prohibition", "odrl:obligation": "obligation", "odrl:duty": "duty"}

#: Facet keys and the actions and duties they stand for.
ACTIONS = {
    "reproduce": "odrl:reproduce",
    "distribute": "odrl:distribute",
    "modify": "odrl:modify",
    "derive": "odrl:derive",
    "commercial_use": "cc:CommercialUse",
    "charge_distribution_fee": "lic:chargeDistributionFee",
    "change_license": "lic:ChangeLicense",
}
DUTIES = {
    "attribution": "cc:Attribution",
    "notice": "cc:Notice",
    "source_code": "cc:SourceCode",
    "rename": "lic:rename",
    "modification_notice": "lic:modificationNotice",
    "compliant_license": "lic:compliantLicense",
}
#: Which duties can be asked of which action.
DUTIES_OF = {
    "distribute": ("attribution", "notice", "source_code"),
    "modify": ("rename", "attribution", "modification_notice", "notice", "source_code"),
    "derive": ("rename", "attribution", "modification_notice", "notice", "source_code"),
    "change_license": ("compliant_license",),
}
TARGETS = {"creativework": "lic:CreativeWork", "dataset": "dcmitype:Dataset", "software": "dcmitype:Software"}
SHARE_ALIKE = "cc:ShareAlike"

#: Properties that a profile shows, and their labels.
LABELS = {
    "lic:additionalClauses": "Additionalclauses",
    "dct:alternative": "Alternativenames",
    "cc:attributionName": "Attributionname",
    "odrl:duty": "Duty",
    "scho:endDate": "Enddate",
    "dct:hasVersion": "Hasversion",
    "cc:jurisdiction": "Jurisdiction",
    "cc:legalcode": "Legalcode",
    "lic:LiabilityLimitation": "Liabilitylimitation",
    "cc:license": "Licensedunder",
    "cc:License": "Licensedunder",
    "odrl:permission": "Permissions",
    "odrl:prohibition": "Prohibitions",
    "lic:PromotionSpecification": "Promotionspecification",
    "dct:publisher": "Publisher",
    "dct:source": "Source",
    "scho:startDate": "Startdate",
    "odrl:target": "Target",
    "dct:title": "Title",
    "dct:type": "Type",
    "scho:validFor": "Valid",
    "lic:validityType": "Validity",
    "lic:WarrantyDisclaimer": "Warrantydisclaimer",
    "lic:WarrantyOrLiabilityAcceptance": "Warrantyorliabilityacceptance",
    "spdx:licenseId": "SPDX",
}
#: Names that camel-case splitting leaves whole.
ACRONYMS = ("ODbL", "LaTeX")

#: Dependencies between actions, 41 edges.
DEPENDENCIES = (
    ("cc:Attribution", "odrl:implies", "cc:Notice"),
    ("cc:Attribution", "odrl:includedIn", "odrl:use"),
    ("cc:Attribution", "owl:sameAs", "odrl:attribute"),
    ("cc:Notice", "odrl:includedIn", "odrl:use"),
    ("cc:Notice", "owl:sameAs", "odrl:AttachPolicy"),
    ("cc:ShareAlike", "odrl:includedIn", "odrl:use"),
    ("cc:ShareAlike", "odrl:implies", "cc:SourceCode"),
    ("cc:ShareAlike", "lic:contradicts", "odrl:grantUse"),
    ("cc:ShareAlike", "owl:sameAs", "odrl:shareAlike"),
    ("cc:SourceCode", "odrl:includedIn", "odrl:use"),
    ("cc:SourceCode", "owl:sameAs", "odrl:attachSource"),
    ("lic:chargeLicenseFee", "odrl:implies", "odrl:commercialize"),
    ("lic:chargeLicenseFee", "odrl:implies", "odrl:sell"),
    ("lic:chargeLicenseFee", "odrl:includedIn", "odrl:transfer"),
    ("lic:modificationNotice", "odrl:includedIn", "odrl:AttachPolicy"),
    ("odrl:attribute", "owl:sameAs", "cc:Attribution"),
    ("odrl:copy", "odrl:includedIn", "odrl:use"),
    ("odrl:copy", "owl:sameAs", "odrl:reproduce"),
    ("odrl:derive", "odrl:implies", "cc:DerivativeWorks"),
    ("odrl:derive", "odrl:includedIn", "odrl:use"),
    ("odrl:display", "odrl:includedIn", "odrl:play"),
    ("odrl:display", "odrl:includedIn", "odrl:present"),
    ("odrl:display", "odrl:includedIn", "odrl:use"),
    ("odrl:distribute", "odrl:includedIn", "odrl:use"),
    ("odrl:ensureExclusivity", "odrl:includedIn", "odrl:use"),
    ("odrl:ensureExclusivity", "lic:contradicts", "odrl:commercialize"),
    ("odrl:execute", "odrl:includedIn", "odrl:use"),
    ("odrl:extract", "odrl:implies", "cc:SourceCode"),
    ("odrl:extract", "odrl:includedIn", "odrl:reproduce"),
    ("odrl:extract", "odrl:includedIn", "odrl:use"),
    ("odrl:extract", "owl:sameAs", "odrl:copy"),
    ("odrl:grantUse", "lic:contradicts", "cc:ShareAlike"),
    ("odrl:modify", "odrl:implies", "cc:SourceCode"),
    ("odrl:modify", "odrl:includedIn", "odrl:use"),
    ("odrl:present", "odrl:includedIn", "odrl:use"),
    ("odrl:print", "odrl:includedIn", "odrl:present"),
    ("odrl:print", "odrl:includedIn", "odrl:use"),
    ("odrl:reproduce", "odrl:includedIn", "odrl:copy"),
    ("odrl:reproduce", "owl:sameAs", "odrl:copy"),
    ("odrl:sell", "odrl:includedIn", "odrl:commercialize"),
    ("odrl:sell", "odrl:includedIn", "odrl:transfer"),
)
RELATIONS = ("odrl:includedIn", "odrl:implies", "owl:sameAs")

#: Reasons in a conflict report.
DIRECT_REASON = "Direct permission-prohibition conflict."
DERIVED_REASON = "Derived permission-prohibition conflict. "
GIVEN, DERIVED = "is given in the dependency graph.", "is derived from the statements in the dependency graph."


@dataclass(frozen=True)
class Vocabulary:
    """Prefixes with the two namespaces of a library: its terms (house) and its licences (library)."""

    house: str = "urn:pactum:terms#"
    library: str = "urn:pactum:licences/"
    extra: dict[str, str] = field(default_factory=dict)

    @property
    def prefixes(self) -> dict[str, str]:
        return PREFIXES | {HOUSE: self.house, LIBRARY: self.library} | self.extra

    def iri(self, curie: str) -> str:
        prefix, _, local = curie.partition(":")
        return self.prefixes[prefix] + local

    def curie(self, iri: str) -> str:
        """The compact name under the longest namespace that fits; an IRI outside all of them as it is."""
        fits = [(len(ns), p, ns) for p, ns in self.prefixes.items() if iri.startswith(ns)]
        if not fits:
            return iri
        _, p, ns = max(fits)
        return f"{p}:{iri[len(ns):]}"
