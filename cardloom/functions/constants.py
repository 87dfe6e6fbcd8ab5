"""Rules, word lists and texts whose exact content decides results."""

# Color symbols in canonical order; bit i of an identity mask stands for COLORS[i].
COLORS = ["W", "U", "B", "R", "G"]
ALL_COLORS_MASK = 31
COLORLESS = "C"
FACET_COLORS = ["W", "U", "B", "R", "G", "C"]
DEFAULT_IDENTITY = ["G", "W"]

BASIC_NAMES = {"W": "Plains", "U": "Island", "B": "Swamp", "R": "Mountain", "G": "Forest"}

# Format and product limits.
DECK_SIZE = 100
DECK_SIZE_WITHOUT_COMMANDER = 99
MAX_SPELLS = 63
MAX_DECKS = 100
SEARCH_LIMIT = 20
MAX_COPIES_PER_ADD = 99
DECK_NAME_LENGTH = 80
CANDIDATE_LIMIT = 200

GAME_STAGES = ["Early", "Mid", "Late"]
DEFAULT_POWER_LEVEL = "Focused"
STRONGEST = "Build strongest possible deck"
PREFER_OWNED = "Prefer cards I own"
ONLY_OWNED = "Only use my collection"

ROLE_ORDER = [
    "Counters",
    "Ramp",
    "Card Draw",
    "Removal",
    "Interaction",
    "Protection",
    "Tutor",
    "Recursion",
    "Tokens",
    "Drain",
    "Finisher",
    "Utility",
    "Land",
]
COUNTED_ROLES = ["Ramp", "Card Draw", "Removal", "Protection"]

# Fixed role table: card name -> roles, primary role first.
CARD_ROLES = {
    "Hardened Scales": ["Counters"],
    "The Ozolith": ["Counters"],
    "Ozolith, the Shattered Spire": ["Counters", "Ramp"],
    "Conclave Mentor": ["Counters"],
    "Winding Constrictor": ["Counters"],
    "Branching Evolution": ["Counters"],
    "Doubling Season": ["Counters", "Tokens"],
    "Evolution Sage": ["Counters"],
    "Kodama of the West Tree": ["Counters", "Ramp"],
    "Animation Module": ["Counters", "Tokens"],
    "Cathars' Crusade": ["Counters"],
    "Luminarch Aspirant": ["Counters"],
    "Abzan Falconer": ["Counters"],
    "Mikaeus, the Lunarch": ["Counters"],
    "Vorinclex, Monstrous Raider": ["Counters"],
    "Atraxa, Praetors' Voice": ["Counters"],
    "Ghave, Guru of Spores": ["Counters", "Tokens"],
    "Falco Spara, Pactweaver": ["Counters", "Card Draw"],
    "Smothering Tithe": ["Ramp"],
    "Cultivate": ["Ramp"],
    "Kodama's Reach": ["Ramp"],
    "Llanowar Elves": ["Ramp"],
    "Birds of Paradise": ["Ramp"],
    "Sol Ring": ["Ramp"],
    "Arcane Signet": ["Ramp"],
    "Fellwar Stone": ["Ramp"],
    "The Great Henge": ["Card Draw", "Ramp"],
    "Fathom Mage": ["Card Draw", "Counters"],
    "Esper Sentinel": ["Card Draw"],
    "Rhystic Study": ["Card Draw"],
    "Brainstorm": ["Card Draw"],
    "Mystic Remora": ["Card Draw"],
    "Sylvan Library": ["Card Draw"],
    "Skullclamp": ["Card Draw"],
    "Swords to Plowshares": ["Removal"],
    "Path to Exile": ["Removal"],
    "Generous Gift": ["Removal"],
    "Cyclonic Rift": ["Removal"],
    "Pongify": ["Removal"],
    "Toxic Deluge": ["Removal"],
    "Deadly Rollick": ["Removal"],
    "Feed the Swarm": ["Removal"],
    "Lightning Bolt": ["Removal"],
    "Chaos Warp": ["Removal"],
    "Beast Within": ["Removal"],
    "Walking Ballista": ["Removal", "Counters"],
    "Counterspell": ["Interaction"],
    "Teferi's Protection": ["Protection"],
    "Deflecting Swat": ["Protection"],
    "Heroic Intervention": ["Protection"],
    "Shalai, Voice of Plenty": ["Protection"],
    "Lightning Greaves": ["Protection"],
    "Swiftfoot Boots": ["Protection"],
    "Demonic Tutor": ["Tutor"],
    "Eternal Witness": ["Recursion"],
    "Herd Baloth": ["Tokens", "Counters"],
    "Basri's Lieutenant": ["Tokens", "Counters"],
    "Felidar Retreat": ["Tokens", "Counters"],
    "Hangarback Walker": ["Tokens", "Counters"],
    "Avenger of Zendikar": ["Tokens"],
    "Fable of the Mirror-Breaker": ["Tokens"],
    "Sheoldred, the Apocalypse": ["Drain", "Card Draw"],
    "Craterhoof Behemoth": ["Finisher"],
    "Simic Ascendancy": ["Finisher", "Counters"],
    "Champion of Lambholt": ["Finisher", "Counters"],
    "Scavenging Ooze": ["Utility"],
}
