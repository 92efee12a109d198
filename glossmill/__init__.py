"""Page segmentation and bilingual text jobs on Spark."""
