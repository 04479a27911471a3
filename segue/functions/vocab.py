"""Vocabularies, key tables and enumerations of the domain."""

# fixed values: audio file extensions
AUDIO_EXTENSIONS = [".mp3", ".wav", ".flac", ".m4a", ".aac", ".ogg", ".wma", ".aiff"]

# fixed values: key names and their wheel codes
KEY_CODES = {
    "C Major": "8B", "G Major": "9B", "D Major": "10B", "A Major": "11B", "E Major": "12B", "B Major": "1B",
    "F# Major": "2B", "Db Major": "3B", "Ab Major": "4B", "Eb Major": "5B", "Bb Major": "6B", "F Major": "7B",
    "A Minor": "8A", "E Minor": "9A", "B Minor": "10A", "F# Minor": "11A", "C# Minor": "12A", "G# Minor": "1A",
    "Eb Minor": "2A", "Bb Minor": "3A", "F Minor": "4A", "C Minor": "5A", "G Minor": "6A", "D Minor": "7A",
}

# fixed values: pitch classes and key profiles for correlation
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]

# fixed values: score of each wheel distance
KEY_DISTANCE_SCORES = {0: 1.0, 1: 0.9, 2: 0.7, 3: 0.5, 4: 0.3, 5: 0.15, 6: 0.05}

# fixed values: transition types in enumeration order
TRANSITION_TYPES = [
    "phrase_cut", "crossfade", "beatmatched_blend", "bass_swap", "filter_sweep", "echo_out", "loop_blend", "mashup",
]

# fixed values: semantic labels
MOODS = ["happy", "sad", "melancholic", "romantic", "euphoric", "dark", "dreamy", "calm", "angry", "hopeful", "nostalgic"]
ACTIVITIES = ["dance", "party", "workout", "driving", "late_night", "relaxing", "background", "focused"]
INTENSITIES = ["soft", "moderate", "energetic", "aggressive"]
STYLES = ["electronic", "pop", "rock", "hip_hop", "acoustic", "orchestral", "ambient"]

# fixed values: lyric labels
THEMES = [
    "love", "romance", "heartbreak", "breakup", "longing", "nostalgia", "friendship", "celebration", "party",
    "confidence", "success", "struggle", "anger", "hope", "healing", "freedom", "loneliness", "loss",
    "self_reflection", "motivation",
]
LYRICAL_MOODS = ["happy", "sad", "melancholic", "romantic", "hopeful", "angry", "nostalgic", "celebratory", "confident", "dark"]
RELATIONSHIPS = ["", "romantic", "friendship", "family", "self", "general"]
