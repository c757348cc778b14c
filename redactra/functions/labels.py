"""The label schema as data: 32 labels with kind, group and sensitivity, and the maps from other schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the schema: label -> kind, in schema order (the order defines tag ids).
KINDS = {
    "PERSON": "context",
    "ADDRESS": "context",
    "ORGANIZATION": "context",
    "DATE": "mixed",
    "GENERIC_ID": "mixed",
    "USER_ID": "mixed",
    "SECRET": "mixed",
    "SSN": "format",
    "RRN": "format",
    "FRN": "format",
    "BUSINESS_ID": "format",
    "PASSPORT": "format",
    "DRIVER_LICENSE": "format",
    "CI": "format",
    "IPIN": "format",
    "CARD_NUMBER": "format",
    "CARD_EXPIRY": "format",
    "CVC": "format",
    "VIRTUAL_CARD_NUMBER": "format",
    "ACCOUNT_NUMBER": "format",
    "TRANSACTION_APPROVAL_ID": "format",
    "EMAIL": "format",
    "PHONE": "format",
    "IPADDRESS": "format",
    "MACADDRESS": "format",
    "PORT": "format",
    "URL": "format",
    "ZIPCODE": "format",
    "IMEI": "format",
    "VEHICLE_PLATE": "format",
    "SUBSCRIBER_ID": "mixed",
    "DEVICE_SERIAL": "format",
}
# Label groups.
GROUPS = {
    "identity": ["PERSON", "ORGANIZATION", "USER_ID"],
    "contact": ["PHONE", "EMAIL", "ADDRESS", "ZIPCODE", "URL", "IPADDRESS", "MACADDRESS", "PORT"],
    "national_id": ["RRN", "FRN", "CI", "IPIN", "PASSPORT", "DRIVER_LICENSE", "BUSINESS_ID", "SSN"],
    "financial": ["CARD_NUMBER", "CARD_EXPIRY", "CVC", "VIRTUAL_CARD_NUMBER", "ACCOUNT_NUMBER", "TRANSACTION_APPROVAL_ID"],
    "device": ["IMEI", "DEVICE_SERIAL", "SUBSCRIBER_ID", "VEHICLE_PLATE"],
    "other": ["DATE", "GENERIC_ID", "SECRET"],
}
# Labels of unique identification and the like.
SENSITIVE = ["RRN", "FRN", "CI", "IPIN", "PASSPORT", "DRIVER_LICENSE", "SSN", "CARD_NUMBER", "CVC", "VIRTUAL_CARD_NUMBER", "ACCOUNT_NUMBER", "SECRET"]
# Labels of the sentence corpus -> schema; None drops the span.
SENTENCE_CORPUS = {
    "PS_NAME": "PERSON",
    "PS_NICKNAME": "PERSON",
    "PS_ID": "USER_ID",
    "LC_ADDRESS": "ADDRESS",
    "LC_PLACE": "ADDRESS",
    "LCP_COUNTRY": None,
    "OG_WORKPLACE": "ORGANIZATION",
    "OG_DEPARTMENT": "ORGANIZATION",
    "OGG_EDUCATION": "ORGANIZATION",
    "OGG_CLUB": "ORGANIZATION",
    "OGG_RELIGION": None,
    "CV_POSITION": None,
    "CV_SEX": None,
    "CV_MILITARY_CAMP": "ORGANIZATION",
    "FD_MAJOR": None,
    "DT_BIRTH": "DATE",
    "QT_AGE": None,
    "QT_LENGTH": None,
    "QT_WEIGHT": None,
    "QT_GRADE": None,
    "TM_BLOOD_TYPE": None,
    "QT_CARD_NUMBER": "CARD_NUMBER",
    "QT_ACCOUNT_NUMBER": "ACCOUNT_NUMBER",
    "QT_MOBILE": "PHONE",
    "QT_PHONE": "PHONE",
    "TMI_EMAIL": "EMAIL",
    "TMI_SITE": "URL",
    "QT_IP": "IPADDRESS",
    "QT_RESIDENT_NUMBER": "RRN",
    "QT_ALIEN_NUMBER": "FRN",
    "QT_PASSPORT_NUMBER": "PASSPORT",
    "QT_DRIVER_NUMBER": "DRIVER_LICENSE",
    "QT_PLATE_NUMBER": "VEHICLE_PLATE",
}
# Categories of the cloud service -> schema.
CLOUD_SERVICE = {
    "Person": "PERSON",
    "Address": "ADDRESS",
    "Organization": "ORGANIZATION",
    "PhoneNumber": "PHONE",
    "Email": "EMAIL",
    "URL": "URL",
    "IPAddress": "IPADDRESS",
    "DateTime": "DATE",
    "Date": "DATE",
    "CreditCardNumber": "CARD_NUMBER",
    "KRResidentRegistrationNumber": "RRN",
    "KRPassportNumber": "PASSPORT",
    "KRDriversLicenseNumber": "DRIVER_LICENSE",
    "KRSocialSecurityNumber": "RRN",
    "InternationalBankingAccountNumber": "ACCOUNT_NUMBER",
    "ABARoutingNumber": "ACCOUNT_NUMBER",
    "SWIFTCode": "ACCOUNT_NUMBER",
    "USSocialSecurityNumber": "SSN",
    "Passport": "PASSPORT",
    "DriversLicense": "DRIVER_LICENSE",
    "VehicleRegistration": "VEHICLE_PLATE",
    "BankAccountNumber": "ACCOUNT_NUMBER",
}
# Parts of a nine-label model's names -> schema; the first part found wins.
NAME_PARTS = {
    "handle": "USER_ID",
    "username": "USER_ID",
    "ip_address": "IPADDRESS",
    "ip": "IPADDRESS",
    "account": "ACCOUNT_NUMBER",
    "secret": "SECRET",
    "email": "EMAIL",
    "phone": "PHONE",
    "url": "URL",
    "date": "DATE",
    "address": "ADDRESS",
    "name": "PERSON",
    "person": "PERSON",
}
# Labels whose entity name elsewhere differs; the others keep their own.
ENTITY_NAMES = {
    "ADDRESS": "LOCATION",
    "ZIPCODE": "KR_ZIPCODE",
    "DATE": "DATE_TIME",
    "EMAIL": "EMAIL_ADDRESS",
    "PHONE": "PHONE_NUMBER",
    "IPADDRESS": "IP_ADDRESS",
    "MACADDRESS": "MAC_ADDRESS",
    "CARD_NUMBER": "CREDIT_CARD",
    "ACCOUNT_NUMBER": "KR_ACCOUNT_NUMBER",
    "RRN": "KR_RRN",
    "FRN": "KR_FRN",
    "CI": "KR_CI",
    "IPIN": "KR_IPIN",
    "PASSPORT": "KR_PASSPORT",
    "DRIVER_LICENSE": "KR_DRIVER_LICENSE",
    "BUSINESS_ID": "KR_BRN",
    "SSN": "US_SSN",
    "VEHICLE_PLATE": "KR_VEHICLE_PLATE",
}

LABELS = list(KINDS)
GROUP_OF = {label: group for group, labels in GROUPS.items() for label in labels}
ENTITY_OF = {label: ENTITY_NAMES.get(label, label) for label in LABELS}
LABEL_OF = {entity: label for label, entity in ENTITY_OF.items()}


def tags(labels: list[str] | None = None) -> list[str]:
    """O, then B-, I-, E- and S- of each label: the ids of the tag set."""
    return ["O", *(f"{p}-{label}" for label in labels or LABELS for p in "BIES")]


def literal_map(pairs: dict[str, str | None]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in pairs.items() for x in (k, v)))


def map_label(label: Column, pairs: dict[str, str | None]) -> Column:
    """The schema's label; null for labels that are dropped or unknown."""
    return F.try_element_at(literal_map(pairs), label)


def map_by_part(name: Column, parts: dict[str, str] = NAME_PARTS) -> Column:
    """The label of the first part that the lower-case name contains."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for part, label in reversed(parts.items()):
        out = F.when(low.contains(part), F.lit(label)).otherwise(out)
    return out


def dimension(spark: SparkSession) -> DataFrame:
    """(label, kind, grp, sensitive, ord, entity): 32 rows, safe to broadcast."""
    rows = [(k, KINDS[k], GROUP_OF[k], k in SENSITIVE, i, ENTITY_OF[k]) for i, k in enumerate(LABELS)]
    return spark.createDataFrame(rows, "label string, kind string, grp string, sensitive boolean, ord int, entity string").coalesce(1)
