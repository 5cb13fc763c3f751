"""Fixed values. Results only agree with other users of the same data formats
when these strings and numbers are exactly as written here."""

# --- fixed values: prompt and answer texts -------------------------------
ANSWER_FORCE_STRING = "\n\n**Final Answer**\n\\[\\boxed{"
SYSTEM_PROMPT = (
    "You are a math teacher. You will be given a math problem and you will solve it step by step.\n"
    "You will output your final solution like \\boxed{ANSWER}. Be sure to include relevant units within the brackets and fully evaluate arithmetic expressions.\n"
)

# --- fixed values: chat markers by model family, in the order they are tried
RESPONSE_MARKERS = {
    "llama": "<|start_header_id|>assistant<|end_header_id|>\n\n",
    "qwen": "<|im_start|>assistant\n",
    "r1": "<｜Assistant｜>",
}
QWEN_TURN_END = "<|im_end|>"
R1_SENTENCE_END = "<｜end▁of▁sentence｜>"
THINK_END = "</think>"

# --- fixed values: the seven competition-maths subjects, in loading order
MATH_SUBJECTS = [
    "algebra",
    "counting_and_probability",
    "geometry",
    "intermediate_algebra",
    "number_theory",
    "prealgebra",
    "precalculus",
]

# --- fixed values: defaults of the experiments
TRAIN_FRACTION = 0.7
REJECTION_THRESHOLD = 8.017
REJECTION_TARGET = 500
GENERATION_BATCH = 512
NUCLEUS_MASS = 0.95
TRAINING_MAX_LENGTH = 4096
TRAINING_BATCH = 16
IGNORED_LABEL = -100
