"""Texts of issues by feature and of tips by component, in our own words, and numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import geometry as g

#: feature: (what is off, why it matters, what to do). Other features take their component's tip.
FEATURES = {
    "head_over_base_offset": ("The head leaves the line above the feet.", "Eyes that stay over the base judge the ball better.", "Hold the head still above the feet until the bat has passed."),
    "head_to_lead_knee_alignment": ("Head and lead knee come apart.", "They carry the weight into the ball together.", "Take the head along with the lead knee."),
    "upper_body_balance_offset": ("The upper body tips to one side.", "A tipping body can't finish a shot under control.", "Stand tall from hip to shoulder during the swing."),
    "front_foot_commitment_signal": ("The front foot goes neither far nor clearly.", "Half a step leaves nothing to hit from.", "Choose the step early and plant it before the bat comes down."),
    "lead_elbow_angle": ("The lead elbow bends unlike that of good clips.", "It steers the bat's path.", "Keep the lead elbow up and firm through contact."),
    "lead_elbow_extension_signal": ("The lead arm opens too early or too late.", "Its stretch passes the swing's speed on.", "Let the arm stretch along the ball's line, not across it."),
    "lead_knee_angle": ("The lead knee is bent unlike that of good clips.", "It holds the weight of the step.", "Bend the lead knee and keep that bend until the bat is through."),
    "trail_knee_angle": ("The back knee is bent unlike that of good clips.", "The back leg loads the swing and lets it go.", "Push off from a springy back leg and let it follow."),
    "weight_transfer_signal": ("The weight doesn't travel as the shot needs it.", "Moving weight gives the bat its speed.", "Lean into the shot from the back foot to the front one."),
    "body_center_offset_x": ("The body moves too much or too little to the side.", "Side steps during the swing cost timing.", "Settle the hips before the swing and turn over them."),
    "follow_through_height_signal": ("The hands end too high or too low.", "Where they end tells whether the swing was whole.", "Carry the hands on to shoulder height."),
    "follow_through_extension_signal": ("The arms stop short of a full swing.", "A checked swing loses speed at the ball.", "Reach after the ball before the arms fold."),
    "bat_side_wrist_height_signal": ("The bat-side wrist is higher or lower than in good clips.", "It sets the angle of the bat's face.", "Let the bottom hand follow the top one at its height."),
    "hip_rotation_angle": ("The hips turn too far or not far enough.", "The turn starts the swing.", "Open the hips up to the shot's line and stop there."),
    "hip_rotation_velocity": ("The hips turn too fast or too slowly.", "Their pace leads that of the hands.", "Begin the turn gently and speed up into contact."),
    "shoulder_hip_separation": ("Shoulders and hips don't wind up against each other.", "That stretch stores the swing's force.", "Keep the shoulders back for a moment while the hips begin."),
    "stance_width": ("The feet stand too close or too wide.", "Width is balance against reach.", "Set the feet about as wide as the shoulders."),
    "body_center_offset_y": ("The body rises or sinks during the shot.", "Eyes that move up and down lose the ball.", "Stay at the height of the stance until the shot is done."),
}
#: component: tip.
COMPONENTS = {
    "head_stability_score": "Play a few balls slowly and watch only that the head stays still.",
    "front_foot_commitment_score": "Practise the step alone, then with the swing.",
    "lead_elbow_score": "Swing with the lead arm alone and keep its elbow high.",
    "knee_bend_score": "Hold the bend of both knees in front of a mirror, then swing.",
    "weight_transfer_score": "Start on the back foot and end on the front one in every drill.",
    "follow_through_score": "Finish every swing and hold the end for a moment.",
    "rotation_score": "Turn from the hips first and let the shoulders come after.",
    "balance_score": "End each shot on both feet without a further step.",
}


def feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, *texts) for f, texts in FEATURES.items()], "feature string, issue string, why string, tip string")


def component_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPONENTS.items()), "component string, general string")


def fixed(value: Column, digits: int) -> Column:
    """A number with that many decimals, rounded from its binary value as SQL's and Python's %.nf do.

    ``format_string`` rounds the number's shortest decimal text instead: 98.55, which lies
    below the tie, would become 98.6. It still tells what isn't finite.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.coalesce(F.call_function("format_number", g.finite(value), F.lit(pattern)), F.format_string(f"%.{digits}f", value))
