"""Word lists of the name heuristics.  Lists of a few hundred words are parameters: a folder of one-word-a-line files
(``stopwords.txt``, ``tech_stopwords.txt``, ...) replaces the defaults below."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Short word lists whose effect on names must agree with published results.
GEOGRAPHIC = (
    "New York|San Francisco|Los Angeles|Hong Kong|United States|New Zealand|United Kingdom|South Africa|North America|South America|San Diego|San Jose|Las Vegas|New Delhi|New Jersey|Rhode Island|"
    "North Carolina|South Carolina|West Virginia|North Dakota|South Dakota|Great Britain|Czech Republic|Saudi Arabia|Costa Rica|Puerto Rico|El Salvador|Sri Lanka|Washington|United Nations|Federal Reserve|NATO"
).split("|")
GREETINGS = "Hello Hi Hey Greetings Welcome Dear Good Morning Afternoon Evening hello hi hey greetings welcome dear Γεια Χαίρετε Καλημέρα Καλησπέρα Αγαπητέ Αγαπητή".split()
IMPERATIVES = "Give Take Make Send Schedule Log Review Check Draft Run Have Plan Ask Contact Email Ping Call View Update Select Insert Delete Create Drop Alter Open Close".split()
SURNAMES = (
    "turing kelly ahmed reed steed syed scully connolly reilly mohammed kennedy hardy murphy shelley bradley harvey perry riley bailey king fleming spalding armstrong cummings browning channing downing golding harding "
    "hemingway kipling lansing manning pickering redgrave sterling"
).split()
ROLES = (
    "Access Account Accounts Action Actions Administrator Administrators Analyst Analysts Architect Architects Boss Break Breaks Brother Brothers Call Calls Care Case Choice Choices Client Clinic Clinics Colleague Colleagues "
    "Commission Commissions Consultant Consultants Coworker Coworkers Customer Customers Data Database Day Department Detail Details Developer Developers Director Directors Doc Docs Engineer Engineering Engineers Executive "
    "Executives File Files Form Forms Friend Friends History Husband Id Info Input Inputs Intake Item Items Lead Leads List Manager Managers Meeting Meetings Message Messages Model Models Month Name Note Notes Officer Officers "
    "Order Orders Output Outputs Partner Partners Patient Patients Per Plan Policies Policy Portal Principal Proposal Proposals Protocol Record Records Request Role Section Sections Server Service Sister Sisters Specialist "
    "Specialists Staff Status Strategies Strategy Summary Support System Team Test Tests User Wife Year boss brother brothers colleague colleagues coworker coworkers friend friends husband partner partners sister sisters wife"
).split()
STARTERS = (
    "The This That These Those There Here It In On At By For With From To As After Before During While Because Since Although Though If Unless When Where Why How What Who Which However Therefore Furthermore Moreover "
    "Additionally Meanwhile Instead Otherwise Finally First Second Third Next Then Also But And Or Nor So Yet Please Note Warning Notice Alert Error Info Debug Daily Weekly Monthly Per Patient According Despite Following "
    "Regarding Concerning Given Having Being Some Many Most All Each Every Both Few Several One Two Three Four Five Six Seven Eight Nine Ten Our Their Your His Her My Its We They You He She I Log Review Give Take Make Send "
    "Schedule Draft Run Have Plan Check Customer Client Attn Billed United Federal Hello Hi Hey Greetings Welcome Dear Good Morning Afternoon Evening Is Are Was Were Has Had Do Does Did Can Could Shall Should Will Would May "
    "Might Must Prescribed Diagnosed Reported Told Said Asked Found Seen Called Contacted Καλημέρα Καλησπέρα Χαίρετε Γεια Αγαπητέ Αγαπητή Είδα Άκουσα Έστειλα Βρήκα Πήρα Κάλεσε Ρώτα Στείλε"
).split()
#: Small defaults of our own for the two long lists.
STOPWORDS = "a about after all am an and any are as at be because been before but by can could did do does for from had has have he her here him his how i if in into is it its me my no not of on or our out please she should so some than that the their them then there they this to us was we were what when where which who why will with would you your".split()
TECH = "Next Government Api Http Https Json Sql Url Html Python Java Linux Windows Server Database Cloud Token Project Portal Request Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December".split()


@dataclass(frozen=True)
class Words:
    geographic: tuple = tuple(GEOGRAPHIC)
    greetings: frozenset = frozenset(GREETINGS)
    imperatives: frozenset = frozenset(IMPERATIVES)
    surnames: frozenset = frozenset(SURNAMES)
    roles: frozenset = frozenset(ROLES)
    starters: frozenset = frozenset(STARTERS)
    stopwords: frozenset = frozenset(STOPWORDS)
    tech: frozenset = frozenset(TECH)


_FILES = {"geographic": "geographic_proper_nouns", "greetings": "greetings", "imperatives": "imperative_verbs", "surnames": "protected_surnames", "roles": "role_nouns", "starters": "sentence_starters", "stopwords": "stopwords", "tech": "tech_stopwords"}


def load(folder: str | None = None) -> Words:
    """The defaults, or the files of a folder where it has them."""
    found = {}
    for name, file in _FILES.items() if folder else ():
        path = os.path.join(folder, f"{file}.txt")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                lines = [x.strip() for x in f if x.strip()]
            found[name] = tuple(lines) if name == "geographic" else frozenset(lines)
    return Words(**found)
