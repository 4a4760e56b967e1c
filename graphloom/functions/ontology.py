"""Default types of entities and relations; they fill prompts and may be replaced."""

# Type names.
SIMPLE_ENTITY_TYPES = "PERSON ORGANIZATION LOCATION DATE".split()
ENTITY_TYPES = (
    "AGE FAMILY AWARD IDEOLOGY PERCENT CITY LANGUAGE PERSON COUNTRY LAW PRODUCT CRIME PENALTY PROFESSION DATE MONEY RELIGION "
    "DISEASE NATIONALITY STATE_OR_PROV ORDINAL TIME EVENT DISTRICT WORK_OF_ART ORGANIZATION FACILITY NUMBER LOCATION"
).split()
RELATION_TYPES = (
    "ABBREVIATION AGE_DIED_AT AGE_IS AGENT ALTERNATIVE_NAME AWARDED_WITH CAUSE_OF_DEATH CONVICTED_OF DATE_DEFUNCT_IN "
    "DATE_FOUNDED_IN DATE_OF_BIRTH DATE_OF_CREATION DATE_OF_DEATH END_TIME EXPENDITURE FOUNDED_BY HAS_CAUSE HEADQUARTERED_IN "
    "IDEOLOGY_OF INANIMATE_INVOLVED INCOME KNOWS LOCATED_IN MEDICAL_CONDITION MEMBER_OF ORGANIZES ORIGINS_FROM OWNER_OF "
    "PARENT_OF PART_OF PARTICIPANT_IN PENALIZED_AS PLACE_OF_BIRTH PLACE_OF_DEATH PLACE_RESIDES_IN POINT_IN_TIME PRICE_OF "
    "PRODUCES RELATIVE RELIGION_OF SCHOOLS_ATTENDED SIBLING SPOUSE START_TIME SUBEVENT_OF SUBORDINATE_OF TAKES_PLACE_IN "
    "WORKPLACE WORKS_AS"
).split()
